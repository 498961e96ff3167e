"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* An operator takes a DataFrame and the names of the columns it needs, selects
  only those, and returns a new DataFrame (or a Column), so columns of the
  caller with clashing names never meet the operator's own.
* A null text is an empty text.  A null id stays null in the result.
* Repeated rows are kept: one result row per input row.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Entries an encoder keeps per Python worker; beyond it the cache starts anew.
CACHE_ENTRIES = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Cuts the lineage and survives lost executors, as the files are on shared
    storage; unlike ``checkpoint()`` it computes ``df`` once, not twice.
    The folder is the cluster's to expire.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: str) -> Column:
    """True when crc32 of the id as text is divisible by 5.  A null id counts
    as the empty text, which is held out, so it is never learned from."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5) == 0


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def cuts_cleanly(piece: str) -> bool:
    """Whether a piece of ``text.split(" ")`` can be split into pre-tokens on its
    own, as ``" " + piece`` (the first piece as it is).  No pre-token crosses a
    single space that has no other white space beside it."""
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


#: Ranges of letters and numbers that the ``regex`` module knows
#: and the tokenizer libraries' older Unicode tables do not.
NEWER_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1
1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NEWER = re.compile(
    "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER_LETTERS.split()) + "]"
)
_FIRST_NEWER = chr(0x558)


def pre_tokens(findall, text: str) -> list[str]:
    """``findall(text)`` of a pre-token pattern, with letters that are newer
    than the libraries' tables taken as they take them, as other signs."""
    if text.isascii() or max(text) < _FIRST_NEWER or not _NEWER.search(text):
        return findall(text)
    out, at = [], 0
    for p in findall(_NEWER.sub("", text)):
        out.append(text[at : at + len(p)])
        at += len(p)
    return out
