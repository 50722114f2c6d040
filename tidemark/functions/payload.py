"""Feed payloads and content documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ids import format_id
from tidemark.schemas import REDIRECT_MARK

# The change kinds a feed payload can carry.
CHANGE_KINDS = ("edit", "new", "log")

PAYLOAD_FIELDS = (
    "wiki: STRING, namespace: BIGINT, type: STRING, title: STRING, comment: STRING, revision: STRUCT<new: BIGINT>"
)
ENTITY_FIELDS = "id: STRING, lastrevid: BIGINT"
RESPONSE_FIELDS = "entities: MAP<STRING, STRING>"


def parsed_objects(text: Column, fields: str) -> Column:
    """The JSON objects of a text, as an array to be read with ``only_object``.

    Parsed inside brackets, a text is rejected as a whole (null) when anything but objects is in it, so
    text after the object does not go unnoticed. Evaluate it once, see ``plans.once``.
    """
    bracketed = F.concat(F.lit("["), text, F.lit("]"))
    return F.from_json(bracketed, f"ARRAY<STRUCT<{fields}>>", {"allowSingleQuotes": "false"})


def only_object(objects: Column) -> Column:
    """The object of a text that holds exactly one; null otherwise."""
    return F.when(F.size(objects) == 1, F.get(objects, F.lit(0)))


def is_redirect(comment: Column) -> Column:
    return F.coalesce(F.contains(comment, F.lit(REDIRECT_MARK)), F.lit(False))


def document_revision(data: Column) -> Column:
    """The document's own revision; null unless it is an unsigned whole number."""
    return F.nullif(F.greatest(F.from_json(data, "lastrevid BIGINT")["lastrevid"], F.lit(-1)), F.lit(-1))


def stub_document(type_col: Column, num: Column, revision: Column) -> Column:
    """Stand-in for the document of a new entity whose content is missing."""
    return F.format_string('{"id":"%s", "lastrevid":%d}', format_id(type_col, num), revision)
