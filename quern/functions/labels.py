"""Dates, sizes, hashes, plurals and scores over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of date groups and file sizes, colours of file kinds.
GROUPS = ("Сегодня", "Вчера", "На этой неделе", "В этом месяце", "Ранее")
UNITS = ("Б", "КБ", "МБ")
COLORS = {
    "pdf": "#e5484d", "doc": "#3e63dd", "docx": "#3e63dd", "xls": "#30a46c", "xlsx": "#30a46c", "csv": "#30a46c",
    "ppt": "#f76b15", "pptx": "#f76b15", "zip": "#8e4ec6", "rar": "#8e4ec6", "txt": "#6f6e77",
}
OTHER_COLOR = "#6e5bff"
WEEKDAYS = ("вс", "пн", "вт", "ср", "чт", "пт", "сб")
MONTHS = ("янв", "февр", "мар", "апр", "мая", "июн", "июл", "авг", "сент", "окт", "нояб", "дек")


FULL_MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
# The order of roles, icons by role, and by words in the names of other folders.
ROLE_ICONS = {"inbox": "inbox", "flagged": "star", "drafts": "draft", "sent": "send", "archive": "archive", "all": "layers", "junk": "spam", "trash": "trash"}
ROLE_ORDER = ("inbox", "flagged", "drafts", "sent", "archive", "all", "junk", "trash")
NAME_ICONS = {"работ|work|job|office": "briefcase", "путеш|travel|trip|билет": "plane"}


def to_iso(text: Column, as_of: Column) -> Column:
    """A date text in ISO form; what is missing or no date becomes ``as_of``, since no clock is read."""
    return iso(F.coalesce(F.try_to_timestamp(text), as_of))


def start_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def ago(minutes: Column, as_of: Column) -> Column:
    return as_of - F.make_dt_interval(mins=minutes.cast("int"))


def long_date(ts: Column, as_of: Column) -> Column:
    """A relative day or a date with its weekday, then the time; the year only where it is another one."""
    days = F.datediff(as_of, ts)
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(ts))
    date = F.concat(weekday, F.lit(", "), F.day(ts).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, FULL_MONTHS)), F.month(ts)))
    date = F.when(F.year(ts) == F.year(as_of), date).otherwise(F.concat(date, F.lit(" "), F.year(ts).cast("string"), F.lit(" г.")))
    return F.concat(F.when(days <= 0, "сегодня").when(days == 1, "вчера").otherwise(date), F.lit(", "), F.date_format(ts, "HH:mm"))


def folder_icon(role: Column, name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLE_ICONS.items() for x in kv])
    named = F.lit("folder")
    for pattern, icon in reversed(NAME_ICONS.items()):
        named = F.when(F.lower(name).rlike(pattern), icon).otherwise(named)
    return F.when(F.coalesce(role, F.lit("")) == "", named).otherwise(F.coalesce(F.element_at(known, role), F.lit("folder")))


def opens_inline(content_type: Column, download: Column) -> Column:
    """Whether a browser may show a file: common images and PDF, unless a download is asked for."""
    kind = F.lower(F.coalesce(content_type, F.lit("application/octet-stream")))
    return kind.rlike(r"^image/(?:png|jpe?g|gif|webp|avif|svg\+xml)\z|^application/pdf\z") & ~F.coalesce(download, F.lit(False))


def palette_score(title: Column, keywords: Column, query: str) -> Column:
    """The better of the title's score and four fifths of the keywords'."""
    return F.greatest(fuzzy_score(title, query).cast("double"), F.coalesce(fuzzy_score(keywords, query) * 0.8, F.lit(0.0)))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def date_group(ts: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, ts)
    return F.when(days <= 0, GROUPS[0]).when(days == 1, GROUPS[1]).when(days < 7, GROUPS[2]).when(days < 30, GROUPS[3]).otherwise(GROUPS[4])


def short_date(ts: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, ts)
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(ts))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))
    day = F.concat(F.day(ts).cast("string"), F.lit(" "), month)
    return (
        F.when(days <= 0, F.date_format(ts, "HH:mm")).when(days == 1, "вчера").when(days < 7, weekday)
        .when(F.year(ts) == F.year(as_of), day).otherwise(F.concat(day, F.lit(". "), F.date_format(ts, "yy"), F.lit(" г.")))
    )


def file_size(n: Column) -> Column:
    """Whole units; megabytes below ten with one decimal. Halves round up."""
    kb = F.floor(n / 1024 + 0.5).cast("string")
    mb = F.when(n < 10 * 1024**2, F.format_string("%.1f", F.floor(n / 1024**2 * 10 + 0.5) / 10)).otherwise(F.floor(n / 1024**2 + 0.5).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(f" {UNITS[0]}"))).when(n < 1024**2, F.concat(kb, F.lit(f" {UNITS[1]}"))).otherwise(F.concat(mb, F.lit(f" {UNITS[2]}")))


def file_badge(name: Column) -> Column:
    ext = F.substring(F.lower(F.substring_index(F.coalesce(name, F.lit("")), ".", -1)), 1, 4)
    color = F.lit(OTHER_COLOR)
    for k, v in COLORS.items():
        color = F.when(ext == k, F.lit(v)).otherwise(color)
    return F.struct(F.when(ext == "", "FILE").otherwise(F.upper(ext)).alias("ext"), color.alias("color"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian noun form for a number."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over the characters, unsigned."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda x, c: (x.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hues(seed: Column) -> Column:
    """Two hues of an avatar; the shift is signed, so that the second can be negative."""
    first = seed % 360
    signed = F.when(seed >= 1 << 31, seed - (1 << 32)).otherwise(seed)
    return F.struct(first.alias("h1"), ((first + 40 + F.shiftright(signed, 9) % 60) % 360).alias("h2"))


def fuzzy_score(text: Column, query: str) -> Column:
    """100 for a prefix, 60 - i for a hit at i, 10 if all characters follow in order, else 0."""
    if not query:
        return F.lit(1)
    low, q = F.lower(text), query.lower()
    at = F.locate(q, low)
    loose = "(?s)" + ".*".join("\\" + c if not c.isalnum() else c for c in q)
    return F.when(at == 1, 100).when(at > 1, 60 - (at - 1)).when(low.rlike(loose), 10).otherwise(0)


def stroke_width(base: float, pressure: Column, pen: Column) -> Column:
    p = F.when(pen, F.greatest(F.lit(0.18), F.least(F.lit(1.0), pressure))).otherwise(0.52)
    return F.lit(base) * (F.lit(0.34) + F.lit(0.78) * p)


def crop_box(left: Column, top: Column, right: Column, bottom: Column, width: int, height: int, pad: int = 26, least: int = 4, most: int = 1400) -> Column:
    """The padded box inside the canvas and its scale, or null if it is too small."""
    x, y = F.greatest(F.lit(0.0), F.floor(left - pad)), F.greatest(F.lit(0.0), F.floor(top - pad))
    w, h = F.least(F.lit(float(width)), F.ceil(right + pad)) - x, F.least(F.lit(float(height)), F.ceil(bottom + pad)) - y
    box = F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h)).alias("scale"))
    return F.when((w >= least) & (h >= least), box)


def cycling_line(turn: Column, lines: tuple[str, ...], from_line: int) -> Column:
    """The line of a turn; past the last one the lines from ``from_line`` on (0-based) come again."""
    i, n = F.greatest(F.lit(0), turn - 1), len(lines)
    at = F.when(i < n, i).otherwise(F.lit(from_line) + F.pmod(i - n, F.lit(n - from_line)))
    return F.element_at(F.array(*map(F.lit, lines)), (at + 1).cast("int"))
