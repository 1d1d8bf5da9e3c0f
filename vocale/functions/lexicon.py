"""Stand-in sentiment lexicon and gazetteer: small fixed tables of known size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentiment terms by language.
NEGATIVE_TERMS = {
    "en": (
        "stupid", "clown", "pathetic", "moron", "idiot", "worthless", "trash", "loser", "scum",
        "disgusting", "awful", "broken", "crashes", "damaged", "disappointed", "failed", "horrible",
        "ignored", "lost", "overheats", "rude", "slow", "terrible", "useless", "worst",
    ),
    "it": (
        "danneggiato", "deluso", "difetto", "guasto", "inutile", "lento", "maleducato", "pessima",
        "pessimo", "reclamo", "ritardo", "rotto", "scadente", "terribile", "vergognoso",
    ),
}
POSITIVE_TERMS = {
    "en": (
        "amazing", "best", "excellent", "fantastic", "friendly", "great", "happy", "helpful", "love",
        "perfect", "quickly", "recommend", "reliable", "satisfied", "wonderful",
    ),
    "it": (
        "benissimo", "consigliato", "eccellente", "fantastico", "felice", "gentile", "ottima", "ottimo",
        "perfette", "perfetto", "rapidissima", "risolto", "soddisfatto", "veloce",
    ),
}

# Known organisations and places.
ORGANISATIONS = (
    "Acme", "Amazon", "Apple", "Booking", "DHL", "Dell", "Intesa", "Lenovo", "MediaMarkt",
    "MediaWorld", "PayPal", "Samsung", "Sony", "TIM", "Unieuro", "Windows",
)
PLACES = (
    "Barcelona", "Berlin", "Bologna", "Firenze", "London", "Madrid", "Milan", "Milano", "Munich",
    "Napoli", "Paris", "Roma", "Rome", "Torino", "Venezia",
)


def flat(terms: dict[str, tuple[str, ...]]) -> list[str]:
    return [t for by_lang in terms.values() for t in by_lang]


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    """Lower-case letter runs of a text."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def lexicon_table(spark: SparkSession) -> DataFrame:
    """The lexicon as a table (lang, term, polarity)."""
    rows = [
        (lang, term, polarity)
        for terms, polarity in ((NEGATIVE_TERMS, -1), (POSITIVE_TERMS, 1))
        for lang, by_lang in terms.items()
        for term in by_lang
    ]
    return spark.createDataFrame(rows, "lang string, term string, polarity int")
