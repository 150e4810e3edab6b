"""Export rows, CSV lines and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import phone as PH
from ..rules.regex import BLANKS
from ..rules.vocab import LEAD_STATUS_LABEL, LEVEL_LABEL, WEBSITE_STATUS_LABEL
from . import contacts as CO
from . import findings as FI

# --- fixed values: export columns in file order ----------------------------------------------
EXPORT_COLUMNS = [
    "nombre", "categoria", "ciudad", "direccion", "web", "estado_web", "opportunity_score", "nivel_oportunidad",
    "website_score", "problemas", "telefono", "email", "whatsapp", "instagram", "facebook", "maps",
    "motivo_oportunidad", "estado_comercial", "proximo_seguimiento", "fecha_analisis",
]
# --- end of fixed values ---------------------------------------------------------------------


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def export_rows(business: DataFrame, findings: DataFrame, contacts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The twenty export columns plus ``business_id``; filter, order and limit come from the caller's list.

    ``keep`` names columns of ``business`` to carry along, such as a list position.
    """
    problems = FI.top_titles(findings, "business_id", ["CRITICAL", "HIGH", "MEDIUM"], 6)
    df = business.join(problems, "business_id", "left").join(CO.first_phone(contacts), "business_id", "left")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    raw_phone = F.coalesce("national_phone", "first_phone", F.lit(""))
    reason = F.regexp_replace(text(_optional(df, "opportunity_reason")), r"(^|;\s*)\+(\d+)\s", "$1($2) ")
    values = {
        "nombre": F.col("name"),
        "categoria": F.when(F.col("category_key").isNotNull(), D.category_label(F.col("category_key"))).otherwise(
            text(_optional(df, "primary_category_label"))),
        "ciudad": text(F.col("city")),
        "direccion": text(F.col("formatted_address")),
        "web": text(F.coalesce(_optional(df, "website_url"), F.col("provider_website"))),
        "estado_web": F.coalesce(D.label(WEBSITE_STATUS_LABEL, F.col("website_status")), F.lit("Sin analizar")),
        "opportunity_score": text(F.col("opportunity_score")),
        "nivel_oportunidad": text(D.label(LEVEL_LABEL, F.col("opportunity_level"))),
        "website_score": text(F.col("website_score")),
        "problemas": text(F.col("titles")),
        "telefono": F.coalesce(PH.national(raw_phone, F.col("country_code")), raw_phone),
        "email": text(_optional(df, "primary_email")),
        "whatsapp": text(_optional(df, "whatsapp_url")),
        "instagram": text(_optional(df, "instagram_url")),
        "facebook": text(_optional(df, "facebook_url")),
        "maps": text(_optional(df, "maps_url")),
        "motivo_oportunidad": reason,
        "estado_comercial": text(D.label(LEAD_STATUS_LABEL, F.col("lead_status"))),
        "proximo_seguimiento": D.date_text(F.col("next_follow_up_at")),
        "fecha_analisis": D.date_text(F.col("last_analyzed_at")),
    }
    return df.select("business_id", *keep, *[values[c].alias(c) for c in EXPORT_COLUMNS])


def safe_cell(c: Column) -> Column:
    """Cell text that a spreadsheet will not run as a formula."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\r?\n", " ")
    s = F.regexp_replace(s, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_cell(c: Column, delimiter: str = ";") -> Column:
    s = safe_cell(c)
    quoted = F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))
    return F.when(s.rlike(r'["\n\r]') | F.contains(s, F.lit(delimiter)), quoted).otherwise(s)


def csv_lines(rows: DataFrame, delimiter: str = ";") -> DataFrame:
    return rows.select(
        "business_id", F.concat_ws(delimiter, *[csv_cell(F.col(c), delimiter) for c in EXPORT_COLUMNS]).alias("line")
    )


def write_csv(rows: DataFrame, path: str, delimiter: str = ";") -> None:
    """Part files with CRLF lines, one header file with the byte-order mark sorting first.

    Each part can be concatenated after the header as is; no part passes through the driver.
    """
    spark = rows.sparkSession
    header = spark.createDataFrame([("﻿" + delimiter.join(EXPORT_COLUMNS),)], "value string")
    header.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/0-header")
    csv_lines(rows, delimiter).select(F.col("line").alias("value")).write.mode("overwrite").option(
        "lineSep", "\r\n"
    ).text(f"{path}/1-rows")


def manifest(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.agg(
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"), F.count("*").alias("count")
    )


def write_json(rows: DataFrame, path: str, as_of: Column) -> None:
    """JSON lines beside a one-row manifest with time and count."""
    rows.select(*EXPORT_COLUMNS).write.mode("overwrite").json(f"{path}/rows")
    manifest(rows, as_of).write.mode("overwrite").json(f"{path}/manifest")
