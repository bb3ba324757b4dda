"""Text, url and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of navigation bars, and formats that a reader operates.
NAV_WORDS = [
    "menu", "menú", "inicio", "footer", "saltar", "skip", "subir", "contacto", "aviso", "legal", "privacidad", "cookies", "compartir",
    "imprimir", "descargar", "twitter", "facebook", "instagram", "youtube", "newsletter", "subscrib", "política de cookies",
]
INTERACTIVE = ["simulador", "calculadora", "herramienta", "herramienta interactiva"]


def normal(text: Column) -> Column:
    """Straight quotes, single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), r"\s+", " ")))


def titles_match(a: Column, b: Column) -> Column:
    x, y = normal(a), normal(b)
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x)), F.lit(False))


def nav_density(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.coalesce(F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: w.isin(NAV_WORDS))) / F.size(found)), F.lit(0.0))


def extraction_class(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "empty").when(n < 200, "short").when((nav_density(text) > 0.04) & (n < 2000), "navigation_only").otherwise("ok")


def short_title(text: Column, n: int) -> Column:
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def is_pdf_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PATH"))).endswith(".pdf"), F.lit(False))


def is_pdf_body(body: Column) -> Column:
    return F.coalesce(F.substring(body, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def loose_date(text: Column) -> Column:
    """yyyy, yyyy-mm or yyyy-mm-dd, as far as the text begins with it (after D:, parts beside or one non-digit apart);
    other texts stay as they are, blank ones become null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^D:", ""), r"[+-]\d{2}'\d{2}'?$", ""))
    p = r"^(\d{4})(?:\D?(\d{2})(?:\D?(\d{2}))?)?"
    parts = [F.nullif(F.regexp_extract(bare, p, i), F.lit("")) for i in (1, 2, 3)]
    return F.nullif(F.when(parts[0].isNotNull(), F.concat_ws("-", *parts)).otherwise(bare), F.lit(""))


# Charset names that old pages declare, and the running heads of one known document.
CHARSETS = {"iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "windows-1252": "windows-1252", "cp1252": "windows-1252", "iso-8859-15": "ISO-8859-15"}
RUNNING_HEADS = ["guía de cnmv", "competencias básicas para inversores"]


def decoded(body: Column) -> Column:
    """UTF-8 where valid, else the charset that the first 2 KB declare if it is one of CHARSETS, else replaced bytes."""
    head = F.lower(F.decode(F.substring(body, 1, 2048), "ISO-8859-1"))
    declared = F.regexp_extract(head, r"charset=[\"']?([\w-]+)", 1)
    out = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    for name, charset in CHARSETS.items():
        # Spark decodes a few charsets only; the others differ from ISO-8859-1 in single characters
        plain = F.decode(body, "ISO-8859-1")
        swaps = {chr(b): bytes([b]).decode(charset) for b in range(128, 256) if charset != "ISO-8859-1" and _known(b, charset) and bytes([b]).decode(charset) != chr(b)}
        out = out.when(declared == name, F.translate(plain, "".join(swaps), "".join(swaps.values())) if swaps else plain)
    return out.otherwise(F.make_valid_utf8(body.cast("string")))


def _known(b: int, charset: str) -> bool:
    try:
        return bool(bytes([b]).decode(charset))
    except UnicodeDecodeError:
        return False


def is_page_line(line: Column) -> Column:
    """Blank lines, bare page numbers, a number before a capitalised head of fewer than 50 characters, known heads."""
    s = F.trim(line)
    numbered = s.rlike(r"^\d{1,3}\s+[A-Z][\p{L}\p{N}_\s]{1,40}$") & (F.length(s) < 50)
    return (s == "") | s.rlike(r"^\d{1,3}$") | numbered | F.lower(s).isin(RUNNING_HEADS)


def without_page_lines(text: Column) -> Column:
    """Lines without page numbers and running heads; blanks and line ends squeezed."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: (F.trim(x) == "") | ~is_page_line(x))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def title_guess(text: Column, lines: int = 6) -> Column:
    """The longest of the first lines of five characters or more that have a letter and are no page lines; of equally long
    ones the first; null without any."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    wanted = F.slice(F.filter(trimmed, lambda x: (F.length(x) >= 5) & x.rlike(r"\p{L}") & ~is_page_line(x)), 1, lines)
    best = F.array_max(F.transform(wanted, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return best["x"]


def joined_text(*parts: Column) -> Column:
    """The parts that are not null, with blanks between: corpus texts and profile texts."""
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def lenient_timestamp(text: Column) -> Column:
    """The time that a text names, null where it names none."""
    return F.try_to_timestamp(text)


def subset(needed: Column, have: Column) -> Column:
    """No element of needed is missing from have; nothing needed is always there."""
    return F.size(F.array_except(F.coalesce(needed, F.array().cast("array<int>")), have)) == 0


def first_are_in(needed: Column, have: Column, n: int = 2) -> Column:
    return F.forall(F.slice(needed, 1, n), lambda c: F.array_contains(have, c))


def filled(entries: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull() & (v != ""))


def is_interactive(kind: Column) -> Column:
    return F.lower(kind).isin(INTERACTIVE)


def unescaped(html: Column) -> Column:
    out = html
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def plain(html: Column) -> Column:
    return F.trim(unescaped(F.regexp_replace(html, "<[^>]*>", "")))
