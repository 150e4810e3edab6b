"""Fetched pages, link probes and search hits: the results a crawler hands over as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CAPTURE_SCHEMA = (
    "business_id bigint, seq int, kind string, attempt int, purpose string, requested_url string, url string,"
    "status int, error_code string, error_detail string, headers map<string,string>, body binary,"
    "redirect_chain array<struct<url:string,status:int>>, ttfb_ms bigint, total_ms bigint,"
    "tls struct<authorized:boolean,valid_to:timestamp,issuer:string,subject:string>, https_available boolean,"
    "http_redirects_https boolean, horizontal_overflow boolean, console_errors array<string>"
)
PROBE_SCHEMA = (
    "business_id bigint, seq int, target_url string, target_kind string, status int, error string, bytes bigint"
)
SEARCH_HIT_SCHEMA = "business_id bigint, rnk int, url string, title string, snippet string"

_CHARSET_IN_TYPE = r"(?i)charset=([^;]+)"
_CHARSET_IN_META = r"""(?i)<meta[^>]+charset=["']?([\w-]+)"""


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE_SCHEMA).parquet(path)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE_SCHEMA).parquet(path)


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_HIT_SCHEMA).json(path)


def charset(content_type: Column, body: Column) -> Column:
    """Declared charset: header first, then the start of the document, else UTF-8."""
    header = F.lower(F.trim(F.regexp_extract(content_type, _CHARSET_IN_TYPE, 1)))
    meta = F.lower(F.regexp_extract(F.decode(F.substring(body, 1, 2048), "ISO-8859-1"), _CHARSET_IN_META, 1))
    return F.coalesce(F.nullif(header, F.lit("")), F.nullif(meta, F.lit("")), F.lit("utf-8"))


_LATIN = ["iso-8859-1", "latin1", "ascii", "us-ascii", "windows-1252", "cp1252"]
# bytes 80 to 9F stand for printable characters under every Latin-1 label; the five that have none stay as they are
_HIGH = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_CONTROLS = "".join(c for c, printable in _HIGH if printable)
_PRINTABLE = "".join(printable for _, printable in _HIGH)


def _decode_utf8(body: Column) -> Column:
    """Without a byte-order mark; bytes that are no UTF-8 become replacement characters."""
    marked = F.substring(body, 1, 3) == F.lit(b"\xef\xbb\xbf")
    return F.make_valid_utf8(F.when(marked, F.substring(body, 4, 2_147_483_647)).otherwise(body).cast("string"))


@F.pandas_udf(StringType())
def _decode_other(body: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes in a charset the JVM functions do not offer; an unknown name falls back to UTF-8."""
    def one(raw, label):
        if raw is None:
            return None
        try:
            return bytes(raw).decode(label, "replace")
        except LookupError:
            return bytes(raw).decode("utf-8-sig", "replace")

    return pd.Series([one(b, n) for b, n in zip(body, name)])


def decode_bodies(captures: DataFrame, content_type: Column) -> DataFrame:
    """Add ``charset`` and ``html`` in one pass. UTF-8 and Latin-1 stay in the JVM; Python sees the bodies in other charsets."""
    named = captures.withColumn("charset", charset(content_type, F.col("body")))
    utf8, latin = F.col("charset").isin("utf-8", "utf8"), F.col("charset").isin(_LATIN)
    rest = named.withColumn("html", _decode_other(F.when(~utf8 & ~latin, F.col("body")), F.col("charset")))
    return rest.withColumn("html", F.when(utf8, _decode_utf8(F.col("body"))).when(
        latin, F.translate(F.decode("body", "ISO-8859-1"), _CONTROLS, _PRINTABLE)).otherwise(F.col("html")))


def is_html(content_type: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (ct == "") | F.contains(ct, F.lit("text/html")) | F.contains(ct, F.lit("application/xhtml"))
