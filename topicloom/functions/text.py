"""Text functions as native column expressions.

The rules come from JavaScript regular expressions, whose ``\\w``, ``\\d`` and
``\\b`` are ASCII and whose ``\\s`` and ``trim`` cover the Unicode blanks. Java's
defaults differ, so those classes are written out here.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: blanks, masking patterns, marker, excerpt and label formats ---
JS_BLANKS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
WORD = "0-9A-Za-z_"
REDACTED = "[REDACTED]"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\b\+?\d[\d\s().-]{7,}\d\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
NO_VALUE = "(none)"
DEFAULT_LABEL = "Unlabeled topic"
DEFAULT_SUMMARY = ""
# --- end of fixed values ---

# The blanks of JS_BLANKS one by one.
_BLANK_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B)))

# The first two for Java. An e-mail can only begin where a run of its characters
# begins or where the last match ended; saying so keeps one long unbroken run of
# text linear instead of quadratic. Boundaries are looked back at only once a
# digit is there.
_EMAIL_JAVA = r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++\.[\w.-]+"
_PHONE_JAVA = (
    rf"(?:[0-9](?<![{WORD}][0-9])|\+(?<=[{WORD}]\+)[0-9])"
    rf"[0-9{JS_BLANKS}().-]{{7,}}[0-9](?![{WORD}])"
)

_CARD_DIGITS = r"[0-9](?:[ -]*+[0-9]){12}"
_CARD_JAVA = rf"(?<![{WORD}])(?:[0-9][ -]*?){{13,19}}(?:(?<=[0-9])(?![{WORD}])|(?<=[ -])(?=[{WORD}]))"


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK_CHARS))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{JS_BLANKS}]")


def mask_pii(text: Column) -> Column:
    """E-mail, phone and card passes, each reading what the earlier one left.

    A costly pass runs only on texts that hold what it needs: an ``@``, or 13 digits
    with nothing but blanks and hyphens between them.
    """
    emails = F.regexp_replace(text, _EMAIL_JAVA, REDACTED)
    no_emails = F.when(F.contains(text, F.lit("@")), emails).otherwise(text)
    no_phones = F.regexp_replace(no_emails, _PHONE_JAVA, REDACTED)
    return F.when(no_phones.rlike(_CARD_DIGITS), F.regexp_replace(no_phones, _CARD_JAVA, REDACTED)).otherwise(no_phones)


def _occurrences(text: Column, needle: str) -> Column:
    without = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(without)) / F.lit(len(needle))).cast("int")


def redaction_count(raw: Column, masked: Column) -> Column:
    """Replacements made between ``raw`` and ``masked``.

    No pass can match across a marker's brackets or inside its letters, so every
    replacement adds exactly one marker; the costly patterns run once, not twice.
    """
    return _occurrences(masked, REDACTED) - _occurrences(raw, REDACTED)


def join_nonempty(*parts: Column, separator: str = "\n\n") -> Column:
    """Join the parts that are neither null nor empty."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def ticket_text(subject: Column, description: Column) -> Column:
    return join_nonempty(subject, description)


def excerpt_block(position: Column, subject: Column, description: Column) -> Column:
    """One numbered excerpt; only null, not an empty string, reads as none."""
    return F.concat(
        F.lit("Ticket "), position.cast("string"),
        F.lit(":\nSubject: "), F.coalesce(subject, F.lit(NO_VALUE)),
        F.lit("\nDescription: "), F.coalesce(description, F.lit(NO_VALUE)),
    )


def label_prompt(masked_excerpts: Column) -> Column:
    """Instruction around excerpts that were masked as one joined text."""
    return F.concat(
        F.lit("The support tickets below were grouped because they resemble each other.\n\n"),
        masked_excerpts,
        F.lit(
            "\n\nName their common topic. Answer in two lines and nothing else:\n"
            "Label: <topic in two to five words>\n"
            "Summary: <one sentence on what these customers need>"
        ),
    )


def _after_heading(text: Column, heading: str, default: str) -> Column:
    pattern = rf"(?i){heading}:[{JS_BLANKS}]*([^\n\r\u2028\u2029]+)"
    found = js_trim(F.regexp_extract(text, pattern, 1))
    return F.when(text.rlike(pattern), found).otherwise(F.lit(default))


def parse_label(text: Column) -> Column:
    return _after_heading(text, "Label", DEFAULT_LABEL)


def parse_summary(text: Column) -> Column:
    return _after_heading(text, "Summary", DEFAULT_SUMMARY)


def host_key(url: Column, platform_suffix: str) -> Column:
    """Tenant key of an origin: no scheme, no platform suffix."""
    escaped = platform_suffix.replace(".", r"\.")
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), f"{escaped}$", "")


def normalized_title(title: Column) -> Column:
    return F.lower(js_trim(title))


# ---------------------------------------------------------------------------
# HTML to text
# ---------------------------------------------------------------------------
# Markers stand for layout while tags are taken out: one, two or three line
# breaks between blocks, a forced line break, heading and list bounds.
_BREAK1, _BREAK2, _BREAK3 = "\ue001", "\ue002", "\ue003"
_FORCED, _HEAD_ON, _HEAD_OFF = "\ue004", "\ue005", "\ue006"
_ITEM, _NUMBERED_ON, _LIST_OFF, _BULLETS_ON = "\ue007", "\ue008", "\ue009", "\ue00a"
_LISTS = _ITEM + _NUMBERED_ON + _LIST_OFF + _BULLETS_ON
# White space of preformatted text: a blank and a tab that stay.
_BLANK, _TAB = "\ue00b", "\ue00c"
_MARKERS = r"\uE001-\uE00C"
_RULE = "-" * 40

# What is not closed runs to the end of the page, as in browsers, and is taken in one
# match: no start is tried again.
_UNSEEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    r"|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)"
    r"|<head(?:[\s/][^>]*)?>.*?</head\s*>"
)


# Layout of a tag; closing tags begin with a slash, all others vanish.
_BLOCKS = {
    _BREAK1: "article aside div footer form header main nav section tr /li",
    _BREAK2: "p pre blockquote table",
}
_TAGS = {
    **{tag: mark for mark, names in _BLOCKS.items() for name in names.split()
       for tag in ((name,) if name.startswith("/") else (name, f"/{name}"))},
    **{f"h{n}": (_BREAK3 if n <= 3 else _BREAK2) + _HEAD_ON for n in range(1, 7)},
    **{f"/h{n}": _HEAD_OFF + _BREAK2 for n in range(1, 7)},
    "br": _FORCED, "/br": _FORCED,
    "hr": _BREAK2 + _RULE + _BREAK2,
    "li": _BREAK1 + _ITEM,
    "ol": _BREAK2 + _NUMBERED_ON, "/ol": _LIST_OFF + _BREAK2,
    "ul": _BREAK2 + _BULLETS_ON, "/ul": _LIST_OFF + _BREAK2,
    "td": " ", "/td": " ", "th": " ", "/th": " ",
}
# A quoted value may hold a closing bracket; where quotes are unbalanced, the first one ends the tag.
_TAG_AT_START = r"""^(/?[a-zA-Z][^\s/>]*|[!?])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""

# Names that stand without a semicolon for historical reasons, longest first.
_LEGACY = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
# Looked at before the table of all names is searched.
_OFTEN = ("amp", "nbsp", "lt", "gt", "quot", "copy", "middot")
_NAMED = r"^([A-Za-z][A-Za-z0-9]*);"
_NUMBER_OR_LEGACY = rf"^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(_LEGACY)});?"


def _lay_out_tags(text: Column) -> Column:
    """Replace every tag by its layout marks, in one walk over the tags."""
    pairs = [F.lit(part) for tag, marks in _TAGS.items() for part in (tag, marks)]
    layout = F.create_map(*pairs)

    def piece(part: Column, index: Column) -> Column:
        name = F.lower(F.regexp_extract(part, _TAG_AT_START, 1))
        marks = F.coalesce(F.try_element_at(layout, name), F.lit(""))
        rest = F.substring(part, F.length(F.regexp_extract(part, _TAG_AT_START, 0)) + 1, F.length(part))
        return (
            F.when(index == 0, part)
            .when(name == "", F.concat(F.lit("<"), part))
            .otherwise(F.concat(marks, rest))
        )

    return F.array_join(F.transform(F.split(text, "<"), piece), "")


def _decode_entities(text: Column) -> Column:
    """Decode in one left-to-right pass, so ``&amp;lt;`` ends as ``&lt;``."""
    # One text that the optimizer turns into one constant; thousands of literals would be
    # analysed one by one in every plan.
    table = {name[:-1]: html5[name] for name in sorted(html5) if name.endswith(";")}
    named = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    # References to C1 controls mean the Windows characters of those numbers.
    windows = F.array(*[F.lit(bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n))) for n in range(128, 160)])

    def piece(part: Column, index: Column) -> Column:
        name = F.regexp_extract(part, _NAMED, 1)
        known = reduce(lambda case, often: case.when(name == often, F.lit(table[often])), _OFTEN[1:],
                       F.when(name == _OFTEN[0], F.lit(table[_OFTEN[0]])))
        known = known.when(name != "", F.try_element_at(named, name))
        ref = F.regexp_extract(part, _NUMBER_OR_LEGACY, 1)
        taken = F.when(known.isNotNull(), F.length(name) + 1).otherwise(
            F.length(F.regexp_extract(part, _NUMBER_OR_LEGACY, 0)))
        tail = F.substring(part, taken + 1, F.length(part))
        digits = F.when(
            ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 6), 16, 10)
        ).otherwise(F.substring(ref, 2, 7)).cast("int")
        legal = (digits > 0) & (digits <= 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        char = F.when(digits.between(128, 159), F.get(windows, digits - 128)).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))
        decoded = (
            F.when(known.isNotNull(), known)
            .when(ref.startswith("#"), F.when(legal, char))
            .otherwise(F.try_element_at(named, ref))
        )
        return (
            F.when(index == 0, part)
            .otherwise(F.coalesce(F.concat(decoded, tail), F.concat(F.lit("&"), part)))
        )

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def _upper_headings(text: Column) -> Column:
    def piece(part: Column, index: Column) -> Column:
        heading = F.substring_index(part, _HEAD_OFF, 1)
        rest = F.substring(part, F.length(heading) + 1, F.length(part))
        return F.when(index == 0, part).otherwise(F.concat(F.upper(heading), rest))

    joined = F.array_join(F.transform(F.split(text, _HEAD_ON), piece), "")
    return F.replace(joined, F.lit(_HEAD_OFF), F.lit(""))


def _keep_preformatted(text: Column) -> Column:
    """Line breaks and blanks inside ``pre`` as markers, which no clean-up touches."""

    def piece(part: Column, index: Column) -> Column:
        inside = F.regexp_extract(part, r"(?is)^[^>]*>\n?(.*?)(?=</pre|\z)", 1)
        start = F.regexp_extract(part, r"(?s)^[^>]*>\n?", 0)
        rest = F.substring(part, F.length(start) + F.length(inside) + 1, F.length(part))
        kept = F.translate(F.replace(inside, F.lit("\r"), F.lit("")), "\n \t", _FORCED + _BLANK + _TAB)
        return F.when(index == 0, part).otherwise(F.concat(F.lit("<pre"), start, kept, rest))

    parts = F.split(text, r"(?i)<pre(?=[\s>])")
    return F.when(F.size(parts) > 1, F.array_join(F.transform(parts, piece), "")).otherwise(text)


def _number_items(text: Column) -> Column:
    """Bullets and numbers: one walk over the list marks with a stack of open lists,
    whose entries are the last number used, or -1 for bullets."""
    tokens = F.regexp_extract_all(text, F.lit(f"(?s)[{_LISTS}]?[^{_LISTS}]+|[{_LISTS}]"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<int>").alias("open"))

    def step(state: Column, token: Column) -> Column:
        mark, rest = F.substring(token, 1, 1), F.substring(token, 2, F.length(token))
        lists, depth = state["open"], F.size(state["open"])
        last = F.coalesce(F.get(lists, depth - 1), F.lit(-1))
        below = F.slice(lists, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        number = F.concat(F.lit(_BLANK), (last + 1).cast("string"), F.lit(". "))
        item = F.concat(F.when(last >= 0, number).otherwise(F.lit(f"{_BLANK}* ")), F.ltrim(rest))
        opened = (F.when(mark == _NUMBERED_ON, F.array_append(lists, F.lit(0)))
                  .when(mark == _BULLETS_ON, F.array_append(lists, F.lit(-1)))
                  .when(mark == _LIST_OFF, below)
                  .when((mark == _ITEM) & (last >= 0), F.array_append(below, last + 1)).otherwise(lists))
        said = F.when(mark == _ITEM, item).when(mark.isin(*_LISTS), rest).otherwise(token)
        return F.struct(F.array_append(state["out"], said).alias("out"), opened.alias("open"))

    walked = F.array_join(F.aggregate(tokens, start, step)["out"], "")
    return F.when(text.rlike(f"[{_LISTS}]"), walked).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Readable text of an article body; null and empty give an empty string.

    Scripts, styles, comments and images vanish, link text stays without its
    address, headings are upper-cased, list items get a bullet or a number, blocks are
    set apart by line breaks, and preformatted text keeps its own.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), f"[{_MARKERS}]", "")
    text = _keep_preformatted(F.regexp_replace(text, _UNSEEN, ""))
    text = F.regexp_replace(text, r"[\t\r\n\f\u200B ]{2,}|[\t\r\n\f\u200B]", " ")
    text = _lay_out_tags(text)
    text = F.regexp_replace(text, " {2,}", " ")
    text = _decode_entities(text)
    text = _number_items(_upper_headings(text))
    # No blank beside a break. Then a run of breaks begins with a break.
    breaks = _BREAK1 + _BREAK2 + _BREAK3
    text = F.regexp_replace(text, f" (?=[{breaks}{_FORCED}])", "")
    text = F.regexp_replace(text, f"([{breaks}{_FORCED}]) ", "$1")
    for lesser, mark, lines in (
        (_BREAK1 + _BREAK2, _BREAK3, 3), (_BREAK1, _BREAK2, 2), ("", _BREAK1, 1),
    ):
        before = f"[{lesser}]*" if lesser else ""
        text = F.regexp_replace(text, f"{before}{mark}[{breaks}]*", "\n" * lines)
    return js_trim(F.translate(text, _FORCED + _BLANK + _TAB, "\n \t"))
