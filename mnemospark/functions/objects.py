"""JSON texts as columns, whose keys keep their order; signed references in Arrow batches, as HMAC has no built-in counterpart."""

from __future__ import annotations

import hashlib
import hmac
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: What stands for an escaped backslash and an escaped quote while strings are sought; JSON holds no raw control characters.
_GUARDS = (("\\\\", "\x01"), ('\\"', "\x02"))

# Names of types, and the lines of an outline.
TYPES = {"BOOLEAN": "bool", "BIGINT": "int", "STRING": "str", "VOID": "null", "DOUBLE": "float", "FLOAT": "float"}
OBJECT, ARRAY, MEMBER = "JSON object, %d keys:", "JSON array, %d elements", "  %s: %s"
MORE_KEYS, FIRST_KEYS, MORE, FIRST_TYPE = "  (+%d more keys)", "  element keys: %s%s", " (+%d more)", "  element type: %s"
SAMPLE, CUT, NOTE = "sample: ", "...", "[outline; fetch the reference for the whole]"


def container(text: Column) -> Column:
    """The VARIANT of an object or array that is the whole text; null for anything else, also for objects that repeat a key.

    The parser stops after the first value, so the text is read as a member before one that is named by its digest.
    """
    mark = F.md5(text)
    members = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"'), mark, F.lit('":0}'))).try_cast("map<string,variant>")
    return F.when(text.rlike(r"^[ \t\r\n]*[\[{]") & (F.size(members) == 2) & F.map_contains_key(members, mark), F.try_element_at(members, F.lit("value")))


def squeezed(text: Column) -> Column:
    """JSON without the white space outside its strings."""
    for plain, guard in _GUARDS:
        text = F.replace(text, F.lit(plain), F.lit(guard))
    text = F.regexp_replace(text, r'("[^"]*+")|[ \t\r\n]++', "$1")
    for plain, guard in reversed(_GUARDS):
        text = F.replace(text, F.lit(guard), F.lit(plain))
    return text


def compact(text: Column) -> Column:
    """An object or array without white space, its keys in their order and its values as they are spelled; anything else as it is."""
    return F.when(container(text).isNotNull(), squeezed(text)).otherwise(text)


def type_name(value: Column) -> Column:
    """A VARIANT's type, containers with their size."""
    schema = F.schema_of_variant(value)
    plain = F.when(schema.rlike(r"^DECIMAL\([0-9]+,0\)$"), "int").otherwise("float")
    for name, own in TYPES.items():
        plain = F.when(schema == name, own).otherwise(plain)
    sized = F.when(schema.startswith("OBJECT"), F.format_string("object(%d keys)", F.size(value.try_cast("map<string,variant>"))))
    sized = sized.when(schema.startswith("ARRAY"), F.format_string("array[%d]", F.size(value.try_cast("array<variant>"))))
    return F.coalesce(sized, F.when(schema.isNotNull(), plain), F.lit("null"))


def listing(text: Column, keys: int) -> tuple[Column, Column]:
    """For the text of a container: its lines as an array of strings with nulls, and a sample of it."""
    members = F.map_entries(F.from_json(text, "map<string,variant>"))
    count = F.size(members)
    rows = F.transform(F.slice(members, 1, keys), lambda m: F.format_string(MEMBER, m["key"], type_name(m["value"])))
    of_object = F.flatten(F.array(F.array(F.format_string(OBJECT, count)), rows, F.array(F.when(count > keys, F.format_string(MORE_KEYS, count - keys)))))

    items = F.from_json(text, "array<variant>")
    first, raw = F.get(items, F.lit(0)), F.get_json_object(text, "$[0]")
    names = F.when(F.schema_of_variant(first).startswith("OBJECT"), F.json_object_keys(raw))
    over = F.when(F.size(names) > keys, F.format_string(MORE, F.size(names) - keys)).otherwise("")
    about = F.when(names.isNotNull(), F.format_string(FIRST_KEYS, F.array_join(F.slice(names, 1, keys), ", "), over)).when(F.size(items) > 0, F.format_string(FIRST_TYPE, type_name(first)))
    nested = F.schema_of_variant(first).rlike("^(OBJECT|ARRAY)")
    entry = F.when(F.size(items) > 0, F.when(nested, squeezed(raw)).otherwise(F.coalesce(F.to_json(first), F.lit("null")))).otherwise("")

    is_object = text.rlike(r"^[ \t\r\n]*\{")
    return F.when(is_object, of_object).otherwise(F.array(F.format_string(ARRAY, F.size(items)), about)), F.when(is_object, squeezed(text)).otherwise(F.concat(F.lit("["), entry, F.lit("]")))


def outline(text: Column, most: int = 1200, keys: int = 40, note: str = NOTE) -> Column:
    """The compact text of a container if it fits; else its listing, a note and as much of a sample as fits; null for what is no container."""
    lines, sample = listing(text, keys)
    head = F.concat(F.array_join(lines, "\n"), F.lit("\n" + note))
    room = F.lit(most - 1 - len(SAMPLE)) - F.length(head)
    cut = F.when(F.length(sample) <= room, sample).otherwise(F.concat(F.regexp_replace(F.substr(sample, F.lit(1), room - len(CUT)), r"\s+$", ""), F.lit(CUT)))
    long = F.concat(head, F.when(room > 8, F.concat(F.lit("\n" + SAMPLE), cut)).otherwise(""))
    return F.when(container(text).isNotNull(), F.when(F.length(squeezed(text)) <= most, squeezed(text)).otherwise(long))


def reference(namespace: Column, artifact: Column, expires: int, key: str, scheme: str = "mem") -> Column:
    """A reference whose segments are percent-encoded, with an expiry and the HMAC of both."""

    @F.pandas_udf("string")
    def work(spaces: pd.Series, ids: pd.Series) -> pd.Series:
        def one(space, own):
            path = f"{scheme}://" + "/".join(quote(p, safe="") for p in f"{space}/{own}".split("/"))
            return f"{path}?exp={expires}&sig=" + hmac.new(key.encode(), f"{path}|{expires}".encode(), hashlib.sha256).hexdigest()

        return pd.Series([one(a, b) for a, b in zip(spaces, ids, strict=True)])

    return work(namespace, artifact)
