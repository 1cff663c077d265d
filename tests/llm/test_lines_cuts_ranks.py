"""Infill, line dedup and ranked search against brute force, on awkward rows, and with small blocks and tiers."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from netweir.llm import infill, lines, ranking


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tiles(text, unit):
    return [m[0] for m in re.finditer(infill.UNITS[unit].replace("(?s:.)", "[\\s\\S]"), text)]


def cut(ident, text, unit):
    x = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = tiles(text, unit)
    assert "".join(units) == text
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return ident, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return ident, n, form, len(p), len(m), out, text


@pytest.mark.parametrize("unit", sorted(infill.UNITS))
@pytest.mark.parametrize("block", [3, 128])
def test_infill(spark, made, unit, block):
    extra = [(300 + i, t) for i, t in enumerate(["<P> is here", "a<S", "<", "S>x<", "<<M>", "\U0001f600é\U0001f600", "\n\n", " lead", "x" * 300, "a\r\nb c", "<P" * 9])]
    docs = made.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.selectExpr("doc_id", "text", "doc_id as _k", "text as _text", "1 as _block", "2 as _from")
    got = infill.infilled(docs, unit=unit, block=block).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(cut(*r, unit)) for r in docs.select("doc_id", "text").collect())
    assert {"psm", "spm", "plain"} <= {r["form"] for r in got}


def test_infill_nothing(none):
    assert infill.infill_digest(none).collect() == []


def without_lines(rows, documents):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    split = [((i, (t or "").split("\n"))) for i, t in rows]
    seen = Counter(k for _, ls in split for k in {key(x) for x in ls})
    gone = {k for k, n in seen.items() if k and n >= documents}
    return [(i, len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone)) for i, ls in split]


def test_lines(spark, made):
    rng = random.Random(4)
    pool = ["Terms apply", " terms APPLY\t", "ÄÖ Läuft", "äö läuft", "", "   ", "rare", "\x0bTERMS apply\r", "é"]
    extra = [(400 + i, "\n".join(rng.choice([*pool, f"own {i}"]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    extra += [(500, "\n"), (501, "terms apply"), (502, "terms apply\nterms apply\n\nend\n"), (503, "\n".join(f"l{i}" for i in range(30_000)))]
    docs = made.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("doc_id", "text", "text as h", "1 as _gone", "2 as documents", "3 as _at")
    for documents in (1, 3, 10):
        got = lines.without_frequent_lines(docs, documents=documents).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, without_lines(docs.select("doc_id", "text").collect(), documents)))


def test_lines_nothing(none):
    assert lines.lines_digest(none).collect() == []


def terms_of(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded)


def best(docs, items, top):
    parts = [Counter(terms_of(t)) for _, t in docs]
    count = sum(bool(p) for p in parts)
    total = sum(sum(p.values()) for p in parts)
    df = Counter(k for p in parts for k in p)
    w = {k: math.floor(1000 * math.log((2.0 * count + 2) / (2 * n + 1))) for k, n in df.items()}
    out = []
    for name, text in items:
        asked = Counter(terms_of(text))
        scored = []
        for at, ((doc, _), p) in enumerate(zip(docs, parts, strict=True)):
            m = 75 + 25 * sum(p.values()) * count // max(total, 1)
            score = sum(q * w[k] * (1_000_000_000 * p[k] // (1000 * p[k] + 12 * m)) for k, q in asked.items() if k in p)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at, doc))
        out += [(name, i + 1, x[4], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize(("first", "second", "heavy"), [(1, 2, 1), (4, 16, 2), (4, 16, 40), (1024, 32_768, 12)])
def test_ranking(spark, made, first, second, heavy):
    rng = random.Random(8)
    extra = [(600 + i, " ".join(rng.choice(["Common", "the", f"t{rng.randrange(40)}", f"u{int(rng.paretovariate(0.6))}"]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    docs = made.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("doc_id", "text", "1 as row", "2 as term", "3 as tf", "4 as tier", "5 as n")
    rows = [(i, " ".join(rng.choice(["common", "the", f"T{rng.randrange(40)}", f"u{int(rng.paretovariate(0.6))}", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    rows += [(90, None), (91, ""), (92, "absent-words only;"), (93, "common common the w1"), (93, "common common the w1"), (None, "w7 w8"), (94, extra[5][1])]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("item_id", "text", "1 as item", "2 as score")
    index = ranking.build(docs, wanted=ranking.wanted_terms(items), first=first, second=second)
    out = ranking.search(index, items, top=20, heavy=heavy)
    got = [tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, best(docs.select("doc_id", "text").collect(), rows, 20)))
    assert max(r[0] for r in out.select("tiers").distinct().collect()) == (3 if first < 1024 else 1)


def test_ranking_without_vocabulary(spark, made):
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5")], "item_id long, text string")
    with_all = ranking.search(ranking.build(made), items).collect()
    assert sorted(with_all) == sorted(ranking.ranked(made, items).collect()) and with_all


def test_ranking_nothing(spark, made, none):
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert ranking.ranked(none, items).collect() == []
    assert ranking.ranked(made, items.limit(0)).collect() == []
