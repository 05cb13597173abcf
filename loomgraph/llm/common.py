"""Helpers that several training-text operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import ship
from ..functions.tables import written  # noqa: F401  (operators take it from here)

SCAN_PREFIX = "file:scans/"
LANGS = ("zh", "en", "de", "fr", "es", "ja", "ru")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as there are cores at least, where the input has fewer files than that.

    The shuffle is round-robin, so no key can be hot; inputs that already have enough partitions pass unchanged.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


#: Frequent function words, one set for each language written in Latin letters.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in a was that for on with by it is at from which who had not an be no but each".split()),
    "de": frozenset("der die das und in von zu den mit ist auf für dem des ein eine wurden nach nicht im sich wie an am aus man".split()),
    "fr": frozenset("le la les de des du et un une à dans que qui est fut pour en par ne pas sur au aux l d n".split()),
    "es": frozenset("el la los las de del y un una en que por con fue para se su no al más lo como ningún cada".split()),
}
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]+")
_HAN = re.compile(r"[㐀-鿿]+")
_CYR = re.compile(r"[Ѐ-ӿ]+")
_LAT = re.compile(r"[A-Za-zÀ-ɏ]+")


def _letters(kind: re.Pattern, text: str) -> int:
    return sum(map(len, kind.findall(text)))


def script_lang(text: str) -> str:
    """A quick language guess: by script, and among Latin-script languages by function words; "" for no letters."""
    lat = _letters(_LAT, text)
    if not text.isascii():
        han = _letters(_HAN, text)
        kana = _letters(_KANA, text)
        if han + kana and 2 * (han + kana) >= lat // 3:
            return "ja" if 4 * kana > han else "zh"
        if _letters(_CYR, text) > lat:
            return "ru"
    if not lat:
        return ""
    words = _WORD.findall(text.lower())
    best, top = "en", 0
    for lang, known in FUNCTION_WORDS.items():
        n = sum(map(known.__contains__, words))
        if n > top:
            best, top = lang, n
    return best
