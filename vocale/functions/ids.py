"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocale.functions.text import trim_space

# Fixed value: the URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"

_DASHED = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_ACCEPTED = rf"(?i)^(?:(?:urn:uuid:)?{_DASHED}|\{{{_DASHED}\}}|[0-9a-f]{{32}})$"


def _dashed(digits: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in cuts])


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 id of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return _dashed(
        F.concat(
            F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3),
            variant, F.substring(digest, 18, 15),
        )
    )


def stable_uuid(raw: Column, seed: Column | None = None) -> Column:
    """A UUID in any public spelling as its 36-character form, any other id hashed;
    a blank id takes the hash of the seed, and a random id when the seed is blank too."""
    name = trim_space(F.coalesce(raw, F.lit("")))
    digits = F.lower(F.regexp_replace(name, r"(?i)^urn:uuid:|[{}\-]", ""))
    value = F.when(name.rlike(_ACCEPTED), _dashed(digits)).when(name != "", uuid5(name))
    if seed is not None:
        value = value.when(trim_space(F.coalesce(seed, F.lit(""))) != "", uuid5(seed))
    return value.otherwise(F.uuid())


def document_uuid(doc_id: Column) -> Column:
    raw = doc_id.cast("string")
    return stable_uuid(raw, F.concat(F.lit("document:"), F.coalesce(raw, F.lit(""))))


def source_uuid(source_id: Column) -> Column:
    return stable_uuid(source_id, F.concat(F.lit("source:"), F.coalesce(source_id, F.lit(""))))


def run_uuid(doc_id: Column, epoch_id: Column, model_key: Column) -> Column:
    """The same for every retry of the same work, so a replay rewrites its own rows."""
    return uuid5(F.concat_ws("|", F.lit("run"), doc_id.cast("string"), epoch_id.cast("string"), model_key))
