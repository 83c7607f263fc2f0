"""Text cleaning and tokenising as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the index, and of the keywords of extractive answers.
STOP_WORDS = "a an and are as at be by for from has have how i if in is it its of on or that the this to was what when where which who why with you your".split()
ANSWER_STOP_WORDS = "a an and are as at be by for from how in is it of on or the to was what when where which who why with".split()
#: Named HTML entities.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°", "middot": "·",
}
#: Tags that end a line.
BLOCK_TAGS = "p div br li tr hr section article header footer blockquote pre table ul ol dl dd dt figure figcaption nav aside main form".split()
HIDDEN_TAGS = "script style template svg noscript".split()
#: First bytes (hex) that tell a format, first match first.
SIGNATURES = (
    ("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("7B5C727466", "rtf"), ("D0CF11E0", "binary"), ("89504E47", "binary"),
    ("FFD8FF", "binary"), ("47494638", "binary"), ("1F8B", "binary"), ("7F454C46", "binary"), ("4D5A", "binary"),
)


def tokenize(text: Column) -> Column:
    """Lower case; what is not a-z, 0-9, white space or a dot becomes a blank; words of two characters or more that are no stop
    words, in order and with repeats. Dots stay: `wound.` is not `wound`."""
    # All else parts words: a blank would take its place.
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9.]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def keywords(question: Column) -> Column:
    """Words of three characters or more for extractive answers; here dots go too."""
    words = F.split(F.regexp_replace(F.lower(question), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*ANSWER_STOP_WORDS))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^[\s ﻿]+", ""), r"[\s ﻿]+\z", "")


def upload_text(raw: Column) -> Column:
    """Without byte-order mark, line ends as \\n, trimmed."""
    return trimmed(F.replace(F.regexp_replace(raw, "^﻿", ""), F.lit("\r\n"), F.lit("\n")))


def squeezed_lines(text: Column) -> Column:
    """Runs of blanks as one, no blanks at line ends, one empty line at most, trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), " ?\n ?", "\n")
    return trimmed(F.regexp_replace(text, "\n{3,}", "\n\n"))


def _entity(e: Column) -> Column:
    """What one entity stands for; itself where that is unknown or no character."""
    name = F.lower(F.substring(e, F.lit(2), F.length(e) - 2))
    digits = F.regexp_replace(name, "^#x?0*", "")
    base = lambda n, most: F.when((digits != "") & (F.length(digits) <= most), F.conv(digits, n, 10)).cast("long")
    known = F.when(name.rlike("^#x[0-9a-f]+$"), base(16, 8)).when(name.rlike("^#[0-9]+$"), base(10, 10))  # longer ones are beyond all characters
    sign = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
    out = F.when((known > 0) & (known <= 0x10FFFF) & ~known.between(0xD800, 0xDFFF), sign)
    for entity, value in ENTITIES.items():
        out = F.when(name == entity, value).otherwise(out)
    return F.coalesce(out, e)


def decode_entities(text: Column) -> Column:
    """Named entities and decimal and hexadecimal numbers that are characters, each decoded once, in one pass: what a decoded
    ampersand makes an entity of stays. What is unknown stays too."""
    entity = "&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
    between, found = F.split(text, entity), F.regexp_extract_all(text, F.lit(entity), F.lit(0))
    whole = F.zip_with(between, found, lambda t, e: F.concat(t, F.when(e.isNull(), "").otherwise(_entity(e))))
    return F.when(text.contains("&"), F.array_join(whole, "")).otherwise(text)


def html_markup_off(html: Column) -> Column:
    """A page's text before entities are decoded: no scripts and styles, then no comments; headings as `## `, block tags as line ends."""
    html = F.regexp_replace(html, rf"(?is)<({'|'.join(HIDDEN_TAGS)})\b.*?</\1\s*>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(F.regexp_replace(html, r"(?i)<h[1-6]\b[^>]*>", "\n## "), r"(?i)</h[1-6]\s*>", "\n")
    return F.regexp_replace(F.regexp_replace(html, rf"(?i)</?({'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n"), "<[^>]*>", "")


def html_text(html: Column) -> Column:
    return squeezed_lines(decode_entities(html_markup_off(html)))


def html_title(html: Column) -> Column:
    """The page's title on one line; null where there is none."""
    title = trimmed(F.regexp_replace(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    return F.nullif(title, F.lit(""))


def is_html(text: Column, filename: Column) -> Column:
    return filename.rlike(r"(?i)\.(html?|xhtml)$") | F.left(text, F.lit(2048)).rlike(r"(?i)<!doctype\s+html|<html[\s>]|<body[\s>]")


def is_markdown(filename: Column) -> Column:
    return filename.rlike(r"(?i)\.(md|markdown)$")


def sniff(content: Column) -> Column:
    """The format that a file's first bytes tell: pdf, zip, rtf, binary or else text."""
    head = F.hex(F.substring(content, 1, 8))
    return reduce(lambda rest, s: F.when(head.startswith(s[0]), s[1]).otherwise(rest), reversed(SIGNATURES), F.lit("text"))


def wreckage(text: Column) -> Column:
    """Whether more than 2 % of the first 4,096 characters are U+FFFD, NUL or control characters: a binary read as text."""
    head = F.left(text, F.lit(4096))
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[�\x00-\x08\x0E-\x1F]", ""))
    return F.coalesce(odd > 0.02 * F.length(head), F.lit(False))


def tidy(text: Column) -> Column:
    """Page text as running text: soft hyphens go, words broken at line ends and sentences broken across lines are rejoined."""
    text = F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("­"), F.lit(""))
    text = F.regexp_replace(text, "([a-z])-\n([a-z])", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), " ?\n ?", "\n")
    text = F.regexp_replace(text, r"(\p{L}|,)\n(?=\p{Ll})", "$1 ")
    return trimmed(F.regexp_replace(text, "\n{3,}", "\n\n"))


def note_filename(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(trimmed(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(F.left(slug, F.lit(48)), F.lit("")), F.lit("note")), F.lit(".md"))


def clean_name(raw: Column) -> Column:
    return F.left(trimmed(F.regexp_replace(raw, r"[\x00-\x1F\x7F]", "")), F.lit(24))


def markdown_title(text: Column) -> Column:
    """The last `# ` heading; null where there is none."""
    return F.element_at(F.regexp_extract_all(text, F.lit(r"(?m)^#[ \t]+(.*?)[ \t]*$"), F.lit(1)), F.when(text.rlike(r"(?m)^#[ \t]"), F.lit(-1)))


def body_word_count(text: Column) -> Column:
    """Words of a markdown text without its headings and `source:` lines."""
    lines = F.filter(F.split(text, "\n"), lambda s: ~s.rlike(r"^#|(?i)^source:"))
    return F.size(F.filter(F.split(F.array_join(lines, " "), r"\s+"), lambda w: w != ""))


def title_of(stated: Column, text: Column, filename: Column) -> Column:
    """A stated title, else the last heading, else the file's name without its ending."""
    return F.coalesce(F.nullif(stated, F.lit("")), markdown_title(text), F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", ""))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def lexical_text(title: Column, section: Column, snippet: Column, body: Column | None = None) -> Column:
    """What lexical scoring reads of a passage: its body where that is held, else title, section and snippet."""
    told = F.concat_ws(" ", title, section, snippet)
    return told if body is None else F.coalesce(body, told)


def sectioned_snippet(section: Column, snippet: Column, most: int = 200) -> Column:
    """A snippet as it travels: its section before it, cut to `most` characters."""
    return F.left(F.when(section != "", F.concat(section, F.lit(": "), snippet)).otherwise(snippet), F.lit(most))


def snippet_parts(sent: Column) -> Column:
    """struct(section, snippet) of a sectioned_snippet(): split at the first `: `, no section where there is none."""
    parts = F.split(sent, ": ", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("section"), parts[1].alias("snippet"))).otherwise(F.struct(F.lit("").alias("section"), sent.alias("snippet")))


#: Windows-1252 from 0x80 on, as code points; 0 stands for a byte without a character.
CP1252 = (
    0x20AC, 0, 0x201A, 0x192, 0x201E, 0x2026, 0x2020, 0x2021, 0x2C6, 0x2030, 0x160, 0x2039, 0x152, 0, 0x17D, 0,
    0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x2DC, 0x2122, 0x161, 0x203A, 0x153, 0, 0x17E, 0x178,
)


def cp1252_text(raw: Column) -> Column:
    """Bytes as Windows-1252; bytes without a character go."""
    high = {chr(0x80 + i): chr(c) if c else "" for i, c in enumerate(CP1252)}
    put = F.translate(F.decode(raw, "ISO-8859-1"), "".join(k for k, v in high.items() if v), "".join(v for v in high.values() if v))
    return F.regexp_replace(put, "[\u0080-\u009f]", "")


def size_label(n: Column) -> Column:
    """Bytes in the shortest form: B, KB (a decimal under 10 KB) or MB."""
    kb = F.when(n < 10240, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.0f KB", n / 1024))
    return F.when(n < 1024, F.format_string("%.0f B", n.cast("double"))).when(n < 1048576, kb).otherwise(F.format_string("%.1f MB", n / 1048576))
