from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as T

# JavaScript's \s, \w and \b spelled out for Python.
BLANKS = ("\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_pattern(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern.replace(r"[\d\s().-]", rf"[0-9{BLANKS}().-]"), re.ASCII)


PASSES = [js_pattern(p) for p in (T.EMAIL, T.PHONE, T.CARD)]


def js_mask(text: str) -> tuple[str, int]:
    count = 0
    for pattern in PASSES:
        text, found = pattern.subn(T.REDACTED, text)
        count += found
    return text, count


def masked(spark, texts: list[str]) -> list[tuple[str, int]]:
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    m = T.mask_pii(F.col("t"))
    df = df.withColumn("m", m).select("i", "m", T.redaction_count(F.col("t"), F.col("m")).alias("n"))
    return [(r.m, r.n) for r in sorted(df.collect(), key=lambda r: r.i)]


@pytest.mark.parametrize("text,expected", [
    ("mail a.b+c@ex-ample.co.uk now", "mail [REDACTED] now"),
    ("ring 030 / 901-8204-77 or 030-901820477, please", "ring 030 / [REDACTED] or [REDACTED], please"),
    ("seen 2026-01-15 10:00", "seen [REDACTED]:00"),
    ("+49 301-820-4477.", "+[REDACTED]."),
    ("\u00e9301-820-4477", "\u00e9[REDACTED]"),
    ("301\u00a0820\u00a04477", "[REDACTED]"),
    ("card 4111 1111 1111 1111 end", "card [REDACTED] end"),
    ("a@b.c+d@e.f", "[REDACTED][REDACTED]"),
    ("keep [REDACTED] and x@y.z", "keep [REDACTED] and [REDACTED]"),
    ("12345678", "12345678"),
    ("", ""),
])
def test_mask_cases(spark, text, expected):
    assert js_mask(text)[0] == expected
    assert masked(spark, [text]) == [js_mask(text)]


def test_mask_equals_model_on_random_text(spark):
    rng = random.Random(7)
    alphabet = ["1", "2", "9", "0", "-", " ", "(", ")", ".", "+", "@", "a", "b_", "Z", "\n", "\u00e9", "\u3000",
                "\u00a0", "[", "]", "12345", "x@y.z", "REDACTED", "\u2003"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(6000)]
    for text, got in zip(texts, masked(spark, texts), strict=True):
        assert got == js_mask(text), repr(text)


def test_mask_reads_whole_long_text_in_linear_time(spark):
    long = "x" * 2_000_000
    (got,) = masked(spark, [f"{long} a@b.co {long}"])
    assert got == (f"{long} [REDACTED] {long}", 1)


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


def test_trim_strips_the_whole_blank_set(spark):
    assert column(spark, f"{BLANKS}a b{BLANKS}", T.js_trim) == "a b"
    assert column(spark, BLANKS, T.is_blank) is True
    assert column(spark, None, T.is_blank) is True


@pytest.mark.parametrize("answer,label,summary", [
    ("Label: Lost parcels\nSummary: Where is it?", "Lost parcels", "Where is it?"),
    ("label:\u00a0 Billing  \nSUMMARY: x", "Billing", "x"),
    ("nothing", "Unlabeled topic", ""),
    ("Label:\nSummary: foo", "Summary: foo", "foo"),
    ("Label: a\u0085b", "a\u0085b", ""),
])
def test_label_lines(spark, answer, label, summary):
    assert column(spark, answer, T.parse_label) == label
    assert column(spark, answer, T.parse_summary) == summary


def test_ticket_text_and_excerpt(spark):
    df = spark.createDataFrame([("s", "d"), ("", "d"), (None, None), ("s", "")], "s string, d string")
    joined = [r[0] for r in df.select(T.ticket_text(F.col("s"), F.col("d"))).collect()]
    assert joined == ["s\n\nd", "d", "", "s"]
    block = df.select(T.excerpt_block(F.lit(1), F.col("s"), F.col("d"))).collect()
    assert block[1][0] == "Ticket 1:\nSubject: \nDescription: d"
    assert block[2][0] == "Ticket 1:\nSubject: (none)\nDescription: (none)"


def test_host_key(spark):
    assert column(spark, "https://acme.desk.io", lambda c: T.host_key(c, ".desk.io")) == "acme"
    assert column(spark, "acme.deskxio", lambda c: T.host_key(c, ".desk.io")) == "acme.deskxio"


@pytest.mark.parametrize("html,text", [
    ("<p>Reset <i>the</i> router</p>", "Reset the router"),
    (None, ""),
    ("", ""),
    ("<p>Hold the <b>red</b> button.</p>", "Hold the red button."),
    ("<p>a</p><p>b</p>", "a\n\nb"),
    ("<div>a</div>\n <div>b</div>", "a\nb"),
    ("<h1>Title &amp; more</h1><p>x</p>", "TITLE & MORE\n\nx"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>one</li><li>two</li></ul>end", "* one\n * two\n\nend"),
    ("<ol><li>one</li><li>two</li></ol>", "1. one\n 2. two"),
    ("x<script>if (a<b) '</p>'</script>y<!-- <p>no</p> -->z<style>p{}</style>", "xyz"),
    ('<a href="http://a.b">link</a><img src="i.png" alt="pic">', "link"),
    ("&amp;lt; &lt;b&gt; &#39;&#x41;&#128512; &nope; &copy;&nbsp;", "&lt; <b> 'A\U0001f600 &nope; \u00a9"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p>open <b>tags\n never   closed", "open tags never closed"),
    ("<P CLASS='x'>caps</P>", "caps"),
    ("<pre-x>custom</pre-x>", "custom"),
    ("it&apos;s &check; a&nbsp b &#146;x&#x80; &ampx &notit; &#0; &#65", "it's \u2713 a\u00a0 b \u2019x\u20ac &x \u00acit; &#0; A"),
    ('<a title="x > y">t</a> <img alt=\'>\'>u', "t u"),
    ('<p title="unbalanced>v</p>', "v"),
    ("<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>", "1. a\n\n * b\n\n 2. c"),
    ("<ul><li>a<ol><li>b<li>c</ol><li>d</ul><ol><li>e</ol>", "* a\n\n 1. b\n 2. c\n\n * d\n\n 1. e"),
    ("<p>x</p><pre>one\n  two\tthree</pre><p>y  z</p>", "x\n\none\n  two\tthree\n\ny z"),
])
def test_html_to_text(spark, html, text):
    assert column(spark, html, T.html_to_text) == text
