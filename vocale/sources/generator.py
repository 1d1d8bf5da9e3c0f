"""Bilingual feedback generator, deterministic per seed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.functions.ids import uuid5

# The feedback texts by language and tone, and the sources.
POOLS = {
    ("it", "positive"): (
        "Ho acquistato un iPhone 15 presso Apple Roma Est e la consegna DHL è stata rapidissima.",
        "Ottima esperienza con Amazon Italia: il mio Lenovo ThinkPad è arrivato in perfette condizioni a Milano.",
        "Il servizio clienti di Booking.com mi ha aiutato subito durante il soggiorno a Firenze.",
        "Ho ordinato delle cuffie Sony WH-1000XM5 su MediaWorld e il ritiro a Torino è stato perfetto.",
        "L'assistenza di PayPal Italia ha risolto il problema del pagamento in meno di un'ora.",
        "Il Samsung Galaxy S24 comprato da Unieuro a Napoli funziona benissimo.",
    ),
    ("it", "negative"): (
        "Il servizio clienti di TIM non ha risolto il guasto sulla mia linea a Roma.",
        "Il software di Acme Corp va in crash su Windows 11 ogni volta che apro il report mensile.",
        "Ho comprato un MacBook Air da Apple Milano, ma il supporto Apple non ha gestito il difetto dello schermo.",
        "La consegna DHL del mio ordine Amazon è arrivata a Bologna con tre giorni di ritardo e il pacco era danneggiato.",
        "L'app di Intesa Sanpaolo si blocca continuamente sul mio iPhone 14 dopo l'ultimo aggiornamento.",
        "Booking.com non ha gestito correttamente il reclamo relativo all'hotel di Venezia.",
    ),
    ("en", "positive"): (
        "Amazon delivered my Sony WH-1000XM5 to London in one day, and the packaging was excellent.",
        "I had a great experience with Booking.com during my trip to Barcelona.",
        "The Apple Store in Berlin replaced my iPhone 15 battery quickly and professionally.",
        "PayPal support resolved my refund issue for an eBay order within a few hours.",
        "My Lenovo ThinkPad from MediaMarkt in Munich works exactly as described.",
        "DHL delivered my Samsung Galaxy S24 to Paris earlier than expected.",
    ),
    ("en", "negative"): (
        "The support team at PayPal ignored my refund request for an order from eBay.",
        "My Dell XPS 13 purchased from MediaMarkt in Berlin overheats after the latest update.",
        "Booking.com did not respond to my complaint about the hotel in Milan.",
        "The new Acme Corp software crashes every time I upload files on Windows 11.",
        "Apple Support failed to solve the screen issue on my MacBook Pro in Rome.",
        "DHL lost my Amazon package during delivery to Madrid.",
    ),
}
SOURCES = ("source-web", "source-app", "source-email")


def _draw(seed: int, row: Column, what: str) -> Column:
    """A number in [0, 2^32) from the row id; the same on every engine that has md5."""
    key = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(what))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def generate_feedback(rows: DataFrame, row_id: str, negative_ratio: float = 0.4, seed: int = 42) -> DataFrame:
    """One message per row of a table (or of ``spark.range``): language, tone, text and source
    are drawn from the row id, so any number of rows is made in parallel and twice the same."""
    row = F.col(row_id)

    def pick(values, what: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (_draw(seed, row, what) % len(values)).cast("int"))

    drawn = rows.select(
        row.alias("row_id"),
        uuid5(F.concat_ws("|", F.lit("feedback"), F.lit(str(seed)), row.cast("string"))).alias("ID"),
        pick(SOURCES, "source").alias("SourceID"),
        pick(("it", "en"), "lang").alias("Lang"),
        F.when(_draw(seed, row, "tone") < int(negative_ratio * 2**32), "negative").otherwise("positive").alias("tone"),
    )
    text = F.lit(None).cast("string")
    for (lang, tone), pool in POOLS.items():
        here = (F.col("Lang") == lang) & (F.col("tone") == tone)
        values = F.array(*[F.lit(v) for v in pool])
        at = (_draw(seed, F.col("row_id"), "text") % len(pool)).cast("int")
        text = F.when(here, F.get(values, at)).otherwise(text)
    return drawn.select("row_id", "ID", "SourceID", text.alias("Text"), "Lang")
