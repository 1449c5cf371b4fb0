"""Golden strings, HTML traps and the ordered logit."""

import math

import numpy as np
from pyspark.sql import functions as F
from retrospect.functions import html
from retrospect.functions import text as x
from retrospect.operators.evaluation import fit_ordered_logit


def _one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column).first()[0]


def test_golden_strings(spark):
    number = x.mixed_fraction(F.col("t"))
    assert [_one(spark, number, t=t) for t in ("3-1/2", "1/4", "2", "2.5")] == [3.5, 0.25, 2.0, 2.5]
    assert _one(spark, x.cleaned(F.col("t")), t="  a—b “c”\n d ") == 'a-b "c" d'
    assert _one(spark, x.terms(F.col("t")), t="The rates RISING in classes, it rained") == ["rat", "ris", "class", "rain"]
    assert _one(spark, x.slug(F.col("t")), t=" Jane Q. Doe ") == "jane-q-doe"
    assert _one(spark, x.surname(F.col("t")), t="John Doe Jr") == "Doe"
    assert _one(spark, x.redacted(F.col("t"), ["Doe", "Jane Doe"]), t="JANE DOE and doe, Doer") == "[MEMBER] and [MEMBER], Doer"
    assert _one(spark, x.speaker_segments(F.col("t"), "([A-Z]+): "), t="lead A: one B: A: two") == [("A", "one"), ("A", "two")]


def test_html(spark):
    page = '<script>var t="</p>";</script><p>One<br>two<p>Three</p><p> </p><a href="/x?q=1#f">l</a><a href="https://other.com/">o</a><p>open'
    pages = spark.createDataFrame([(1, "https://a.com/b", page), (2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.paragraphs(pages).collect()] == [(1, 1, "One two"), (1, 2, "Three")]
    assert [r.lines for r in html.line_blocks(pages).collect()] == [["One", "two"], ["Three"], ["open"]]
    assert [tuple(r) for r in html.links(pages).collect()] == [(1, "https://a.com/x")]


def test_ordered_logit(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3000, 2))
    score = z @ [1.5, -0.7] + rng.logistic(size=3000)
    label = np.where(score < -1, 0, np.where(score < 1, 1, 2))
    rows = spark.createDataFrame([(float(a), float(b), int(y)) for (a, b), y in zip(z, label)], "a double, b double, y int")
    theta, trace = fit_ordered_logit(rows.cache(), ["a", "b"], "y")
    assert all(later >= earlier for earlier, later in zip(trace, trace[1:]))
    assert np.allclose(theta, [1.5, -0.7, -1.0, math.log(2.0)], atol=0.2)
