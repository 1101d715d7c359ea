"""Personal data: base spans against plain patterns in Python, boosting and thresholds, redaction."""

import re

import numpy as np
import pytest
from helpers import documents, sha
from pyspark.sql import functions as F

from docreview.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = ["", None, "a@b.c_d@e.f x@y", "@a.b a@.b a@b. a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
       "+1 (830) 555-5433, +12 +1 2 +1 (((((", "\U0001F600é a.b@c.de\n日本 +49 30 1234567 10.0.0.1", "12 34 56 78 90 12 34 5 6 79927398713 00000000000000",
       "1" * 200_000, "a" * 200_000 + "@", "a@b" + ".c" * 20_000, "1-" * 30_000 + "1", "+1" + "(" * 100_000, "1.1.1.1 " * 5_000,
       "x+1@y.z+1 (212) 555-0000", "4111 1111 1111 1111", "4111 1111 1111 1111", "bob [at] site (dot) org and bob@site.org"]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    tests = {"email": lambda m: True, "ip": lambda m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split(".")),
             "card": lambda m: 14 <= len(d := re.sub(r"[ -]", "", m)) <= 19 and luhn(d), "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15}
    found = [(m.start(), i, m.end()) for i, k in enumerate(pii.KINDS) for m in re.finditer(SAFE.get(k, PLAIN[k]), text or "") if tests[k](m.group())]
    return sorted(found)


#: The plain email and address patterns take the square of a run's length; runs are tried once here too.
SAFE = {"email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}


def report(rows):
    return {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows}


def wanted(text):
    found = base_spans(text)
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return (*(sum(k == i for _, k, _ in found) for i in range(4)), sha(joined))


def run(spark, folder, rows):
    documents(spark, rows).withColumnRenamed("n", "start").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return pii.op11_pii(spark, str(folder)).collect()


def test_odd_texts(spark, tmp_path):
    small = [t[:2_000] if t and set(t) <= {"1", "a", "@"} else t for t in ODD]
    done = run(spark, tmp_path, list(enumerate(small)))
    assert report(done) == {i: wanted(t) for i, t in enumerate(small)}


def test_very_long_runs_end(spark, tmp_path):
    rows = [(0, "1" * 200_000), (1, "a" * 200_000 + "@"), (2, "a@b" + ".c" * 50_000), (3, "1-" * 100_000), (4, "1." * 100_000)]
    done = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    assert done[2].n_email == 1 and done[4].n_ip == 25_000 and done[0].spans == done[3].spans == ""


def test_corpus(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    done = pii.op11_pii(spark, sf).collect()
    assert report(done) == {d: wanted(t) for d, t in texts.items()}
    for r in done:
        assert set(base for base in (f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(texts[r.doc_id]))) <= set(r.spans.split(","))


def test_added_spans(spark, tmp_path):
    """Looser formats are added next to what the base finds; numbers that fail their test are not."""
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "4222-2222-2222-2220"]
    rows = [(i, f"pay by card {cards[i % 4]} or call +1 (212) 555-{1000 + i} from 10.0.{i % 256}.7") for i in range(300)]
    rows += [(i, f"order {4111111111111112 + 10 * i} of 300.{i}.1.2 and +1 22") for i in range(300, 600)]
    rows += [(1000, "pay by card 4111.1111.1111.1111 now"), (1001, "order 4111.1111.1111.1112 now"), (1002, "just words 12 and 34")]
    done = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    assert done[1000].spans == "card:12:31" and done[1000].n_card == 0 and done[1000].base_sha256 == sha("")
    assert done[1001].spans == "" and done[1002].spans == ""
    assert done[0].spans.count(":") == 2 * 3


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "a@b.cd"), (None, "a@b.cd"), (3, None), (3, "10.0.0.1")]
    done = sorted((r.doc_id or -1, r.spans) for r in run(spark, tmp_path, rows))
    assert done == [(-1, "email:0:6"), (-1, "email:0:6"), (3, ""), (3, "ip:0:8")]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_boosting_learns_an_exclusive_or():
    names = list(pii.LEVELS)
    levels = np.zeros((4, len(names)), int)
    levels[:, names.index("formed")], levels[:, names.index("context")] = [0, 0, 1, 1], [0, 1, 0, 1]
    good, bad = np.array([5.0, 90, 95, 0]), np.array([95.0, 3, 2, 100])
    trees = pii.boost(levels, good, bad)

    def value(tree, row):
        while "value" not in tree:
            tree = tree["yes" if row[names.index(tree["feature"])] == tree["level"] else "no"]
        return tree["value"]

    margins = [sum(value(t, row) for t in trees) for row in levels]
    assert margins[0] < 0 < margins[1] and margins[3] < 0 < margins[2]


def test_thresholds():
    found = pii.thresholds([(0, 0.9, 60, 0), (0, 0.5, 10, 1), (0, 0.2, 0, 50), (1, 0.9, 3, 3)])
    assert found == {0: 0.5}


def test_no_python_in_the_plan(spark, sf):
    plan = pii.op11_pii(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_redact(spark):
    text = "é a@b.cd, 10.0.0.1!"
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(k).alias("kind"), F.lit(b).cast("long").alias("end"))
                      for a, k, b in base_spans(text)])
    assert spark.range(1).select(pii.redact(F.lit(text), spans).alias("t")).first().t == "é [email], [ip]!"
