"""Request, event and settings texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_frames(df: DataFrame, body: str) -> DataFrame:
    """One row for each event of a stream's text: event, data (JSON text). Comments and frames without valid data go."""
    raw = df.withColumn("__raw", F.explode(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n\n")))
    lines = F.filter(F.split("__raw", "\n"), lambda x: ~x.startswith(":"))
    event = F.try_element_at(F.filter(lines, lambda x: x.startswith("event:")), F.lit(-1))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    out = raw.withColumns({"event": F.coalesce(F.trim(F.substring(event, 7, 1 << 20)), F.lit("message")), "data": F.array_join(data, "\n")})
    return out.filter((F.size(data) > 0) & F.try_parse_json("data").isNotNull()).drop("__raw")


def data_url(url: Column) -> Column:
    """(media_type, content) of an image url; null if it isn't one."""
    form = r"(?s)\Adata:image/(png|jpeg|webp);base64,([A-Za-z0-9+/=\s]+)\z"
    body = F.regexp_replace(F.regexp_extract(url, form, 2), r"\s+", "")
    return F.when(url.rlike(form), F.struct(F.concat(F.lit("image/"), F.regexp_extract(url, form, 1)).alias("media_type"), F.try_to_binary(body, F.lit("base64")).alias("content")))


def requests(df: DataFrame, body: str, schema: str, most_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """JSON bodies within the size limit, parsed; malformed ones are null."""
    return df.filter(F.octet_length(body) <= most_bytes).withColumn("request", F.from_json(body, schema))


def settings_lines(df: DataFrame, line: str) -> DataFrame:
    """key, value of each ``key=value`` line; comments and blank lines go, and so does one pair of quotes."""
    bare = F.trim(F.col(line))
    at = F.instr(bare, "=")
    value = F.trim(F.expr(f"substring(trim({line}), instr(trim({line}), '=') + 1)"))
    quoted = value.rlike(r"""(?s)\A(?:".*"|'.*')\z""") & (F.length(value) > 1)
    rows = df.filter((bare != "") & ~bare.startswith("#") & (at > 1))
    return rows.select(F.trim(F.substring_index(bare, "=", 1)).alias("key"), F.when(quoted, F.expr(f"substring(trim(substring(trim({line}), instr(trim({line}), '=') + 1)), 2, length(trim(substring(trim({line}), instr(trim({line}), '=') + 1))) - 2)")).otherwise(value).alias("value"))


def resolved_accounts(accounts: DataFrame, presets: DataFrame) -> DataFrame:
    """Mail accounts from settings and provider presets; incomplete and demo ones go."""
    p = presets.select(F.col("provider").alias("__p"), F.col("imap").alias("__imap"), F.col("smtp").alias("__smtp"), F.col("smtp_port").alias("__port"))
    j = accounts.join(p, F.lower("provider") == F.col("__p"), "left")
    user, password = F.coalesce("imap_user", "mail_user"), F.coalesce("imap_pass", "mail_pass")
    host = F.coalesce("imap_host", "__imap")
    port, out_port = F.coalesce("imap_port", F.lit(993)), F.coalesce("smtp_port", "__port", F.lit(465))
    out = j.withColumns({"user": user, "has_password": password.isNotNull(), "imap": host, "imap_port": port, "smtp": F.coalesce("smtp_host", "__smtp", F.regexp_replace(host, r"^imap\.", "smtp.")), "smtp_port": out_port})
    out = out.withColumns({"imap_secure": F.coalesce("imap_secure", F.col("imap_port") == 993), "smtp_secure": F.coalesce("smtp_secure", F.col("smtp_port") == 465)})
    return out.filter(F.col("imap").isNotNull() & F.col("user").isNotNull() & F.col("has_password") & ~F.coalesce("demo", F.lit(False))).drop("__p", "__imap", "__smtp", "__port")
