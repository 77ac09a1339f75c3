"""Quality rules, decontamination, licenses, personal data and the classifiers."""

import hashlib
import re
import textwrap

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import decontamination as dc
from lexispark.llm import license_scan as ls
from lexispark.llm import pii, quality_classifier, supervised, toxicity
from lexispark.llm import quality_rules as qr
from lexispark.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    w = WORDS.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, dup = text.split("\n"), 0
    for i, x in enumerate(lines):
        dup += bool(WORDS.search(x)) and x in lines[:i]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_line_field_does_not_change_with_copies_and_size(spark, small):
    docs, labels = table(spark, small, "documents").select("doc_id", "text"), table(spark, small, "labels")
    w, trans = qr.fit(docs, labels, 40)
    more = docs.withColumn("doc_id", qr.F.col("doc_id") + 10**9)  # copies that no label is for, nulls and empty texts
    rest = spark.range(5000).selectExpr("id + 2000000000 AS doc_id", "CASE WHEN id % 2 = 0 THEN '' END AS text")
    again = qr.fit(docs.union(more).union(rest), labels, 40)
    assert np.abs(w).max() > 0.1 and (w == again[0]).all() and (trans == again[1]).all()


def marked_lines(rng, low):
    """A document's lines: of a low one nearly all are junk, and a few plain short ones stand among them."""
    junk = lambda: b" ".join(bytes(rng.choice(list(b"abcdef"), 5)) + b"###" for _ in range(9))
    plain = lambda n: b" ".join(bytes(rng.choice(list(b"abcdef"), 5)) for _ in range(n)) + b"."
    return [plain(1) if rng.random() < 0.15 else junk() if low else plain(int(rng.integers(5, 12))) for _ in range(12)]


def test_neighbours_decide_line_labels():
    """The field learns from whole documents which lines are junk; the same plain line follows its neighbours either way."""
    rng = np.random.default_rng(1)
    low = np.arange(120) % 2 == 0
    w, trans = qr.train([qr.line_features(marked_lines(rng, x)) for x in low], low)
    amid = qr.line_features([b"aaa bbb### ccc### ddd###"] * 3 + [b"Plain."] + [b"eee fff### ggg### hhh###"] * 3)
    assert qr.viterbi(amid, w, trans).tolist() == [1] * 7
    assert qr.viterbi(qr.line_features([b"Plain words of some length here."] * 3 + [b"Plain."]), w, trans).tolist() == [0] * 4
    assert np.abs(qr.train([amid, amid], np.array([True, True]))[0]).max() == 0  # one class alone teaches nothing


def test_marginals_and_bounds():
    rng = np.random.default_rng(2)
    score, trans = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    paths = [[(k >> i) & 1 for i in range(4)] for k in range(16)]
    weight = np.array([np.exp(sum(score[0, i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
    p, both = qr.marginals(score, trans, np.ones((1, 4)))
    assert p[0, :, 1] == pytest.approx([(weight * [x[i] for x in paths]).sum() / weight.sum() for i in range(4)])
    assert both[0, 1] == pytest.approx(sum(w * sum(a == (0, 1) for a in zip(x, x[1:], strict=False)) for w, x in zip(weight, paths, strict=True)) / weight.sum())
    for low in (True, False):
        share = qr.constrained(score, trans, np.ones((1, 4)), np.array([low]))[0][0, :, 1].mean()
        assert share >= qr.MOST - 1e-2 if low else share <= qr.LEAST + 1e-2


def test_stretches_keep_the_texts_own_ends():
    for n in (1, 40, 41, 500):
        lines = [f"line {k} of a long text.".encode() for k in range(n)]
        whole, got = qr.line_features(lines), [qr.stretch(b"\n".join([*lines[:-1], lines[-1] + b"!" * k])) for k in range(60)]
        assert {len(x) for x in got} == {min(n, qr.LINES)}
        ends = {(bool(x[0, -2]), bool(x[-1, -1])) for x in got}
        assert ends == {(True, True)} if n <= 40 else len(ends) > 1 and (True, True) not in ends
        assert whole[0, -2] and whole[-1, -1]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab é#|\n\t\x85　"), max_size=60))
def test_rules_base(text):
    assert qr.base(text.encode()) == slow_base(text)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 8))
        x, w, t = rng.normal(size=(n, 3)), rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
        s = x @ w
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
        value = lambda p: sum(s[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert value(qr.viterbi(x, w, t).tolist()) == pytest.approx(max(map(value, paths)))


def test_rules_keep_and_drop(spark, small, odd, none):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    model = qr.fit(docs, labels)
    got = {r["doc_id"]: r for r in qr.rules(docs, model).collect()}
    quality = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    clean = [got[d]["kept"] for d, q in quality.items() if q == 1 and not got[d]["base_failed"]]
    assert all(clean) and len(clean) > 10
    junk = [got[d]["kept"] for d, q in quality.items() if q == 0 and not got[d]["base_failed"]]
    assert len(junk) > 4 and sum(junk) <= 0.1 * len(junk)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for d, r in got.items():  # against one text at a time
        assert r["kept"] == (not r["base_failed"] and qr.content_share(texts[d], *model) >= 0.5)
    r = qr.rules(odd, model).collect()
    assert len(r) == odd.count() and not any(x["kept"] for x in r if x["n_words"] < 50)
    assert qr.rules(none, model).count() == 0 and qr.rules(odd, qr.fit(odd, labels.limit(0))).count() == odd.count()


def test_leaks(spark, small, odd, none):
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {(r["doc_id"], r["item_id"]): r for r in dc.leaks(docs, bench).collect()}
    squeeze = lambda t: " " + " ".join(WORDS.findall(t.lower())) + " "
    exact = {(d["doc_id"], i) for d in docs.collect() for i, t in items if squeeze(t) in squeeze(d["text"] or "")}
    assert exact and exact <= set(got)
    assert all(r["similarity"] >= 0.8 for r in got.values())
    assert dc.leaks(odd, bench).count() == 0 and dc.leaks(docs, none.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).count() == 0
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench, max_items=7).collect()} == set(got)


def test_leaks_of_short_and_edited_items(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    edited = long_.replace("w59", "other")
    docs = spark.createDataFrame([(1, f"before {long_} after"), (2, f"x {edited} y"), (3, "nothing of the kind at all"), (4, "say one two now"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, long_), (11, "One two"), (12, None), (13, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in dc.leaks(docs, bench).collect())
    assert got == [(1, 10, 1), (2, 10, 0), (4, 11, 1)]  # of places that tie the first


def slow_best(doc, item, clamp):
    """The best of all spans of the item's length and the first word of it; with clamp, spans may pass the text's ends."""
    grams = lambda w: dc.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    n, want = len(item), grams(item)
    at = range(1 - n, len(doc)) if clamp else range(len(doc) - n + 1)
    return max(((dc.similarity(grams(doc[max(q, 0) : q + n]), want), -q) for q in at), default=(0, 0))


def test_leaks_with_edits_anywhere():
    rng, reached = np.random.default_rng(3), 0
    for n, edits in ((25, 1), (50, 1), (50, 2), (100, 2), (100, 3), (200, 4)):
        item = [f"i{k}" for k in rng.integers(0, 400, n)]
        texts = []
        for first in range(0, n, 3):
            w = list(item)
            for k in sorted({first, *rng.integers(0, n, edits - 1).tolist()}, reverse=True):
                w[k : k + 1] = [["changed"], [], [w[k], "more"]][rng.choice(3, p=(0.8, 0.1, 0.1))]
            texts.append([f"a{k}" for k in range(9)] + w + [f"b{k}" for k in range(9)])
        got = {d: (s, at) for d, _, at, s, *_ in dc.search([" ".join(t).encode() for t in texts], dc.build([(1, " ".join(item).encode())]), dc.WordHashes())}
        want = {d: (s, max(0, -q)) for d, t in enumerate(texts) for s, q in [slow_best(t, item, True)] if s >= 0.8}
        assert got == want
        reached += len(want)
    assert reached > 100


def test_leaks_that_are_shortened_items(spark):
    for n in (10, 40, 75, 200):
        item = [f"i{k}" for k in range(n)]
        texts = [item[a : n - b] for a in range(n // 4) for b in (0, 1, 2, n // 9)] + [item[2:] + ["after"] * 9, ["before"] * 9 + item[:-2]]
        got = {d: s for d, _, _, s, _ in dc.search([" ".join(t).encode() for t in texts], dc.build([(1, " ".join(item).encode())]), dc.WordHashes())}
        assert got == {d: s for d, t in enumerate(texts) for s, _ in [slow_best(t, item, True)] if s >= 0.8}
    docs = spark.createDataFrame([(1, " ".join(item[3:])), (2, " ".join(item[:-3])), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert sorted((r["doc_id"], r["start_word"], r["n_words"]) for r in dc.leaks(docs, bench).collect()) == [(1, 0, 197), (2, 0, 197)]
    assert [r["doc_id"] for r in dc.drop_leaks(docs, bench).collect()] == [3]


def test_near_tables_bound_the_distance():
    v = np.array([3, 500, 65535], np.int64)
    t = dc.nearest(v, 16)
    for x in range(0, 65536, 977):
        assert t[x] == min((x ^ int(y)).bit_count() for y in v)


def test_many_items_take_wide_blocks():
    rng = np.random.default_rng(1)
    known = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    index = dc.Index(entries={20: (known, np.arange(400), np.zeros(400, int))})
    queries = np.concatenate([known[:50] ^ np.uint64(0b1011), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    at, of = dc.hits(queries, 20, index)
    want = {(i, j) for i in range(len(queries)) for j in range(400) if int(queries[i] ^ known[j]).bit_count() <= 8}
    assert set(zip(at.tolist(), of.tolist(), strict=True)) == want


@pytest.mark.parametrize("width", [40, 52, 64, 80])
def test_wrapped_notices_of_all_templates(width):
    for spdx, text in ls.TEMPLATES:
        assert ls.CUES.search(text.encode())
        wrapped = "Some file of ours.\n\n" + "\n".join(textwrap.wrap(text, width, break_on_hyphens=False)) + "\n\nAnd now for the rest of it."
        got = ls.notices(wrapped.encode())
        assert [(x[0], x[4]) for x in got] == [(spdx, [])], (spdx, width, got)
        assert wrapped.encode()[got[0][1] : got[0][2]].decode().split() == text.split()


def slow_notices(words):
    """Of every stretch of words and every template: those that hold at a tenth of edits, by alignment alone."""
    out = []
    for k, (spdx, text) in enumerate(ls.TEMPLATES):
        t = [p for p in map(ls.plain, text.encode().split()) if p]
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + len(t) + 2 + len(t) // 10) + 1):
                part = words[a:b]
                m = [x for x in ls.SequenceMatcher(None, t, part, autojunk=False).get_matching_blocks() if x.size]
                got, held = {i for x in m for i in range(x.a, x.a + x.size)}, {i for x in m for i in range(x.b, x.b + x.size)}
                missing, extra = [w for i, w in enumerate(t) if i not in got], [w for i, w in enumerate(part) if i not in held]
                if 0 in held and b - a - 1 in held and max(len(missing), len(extra)) <= 0.1 * len(t) and not ls.TELLING & {*missing, *extra}:
                    out.append((len(missing) + len(extra), a - b, k, spdx))
    return min(out, default=None)


def test_notices_against_all_stretches():
    rng = np.random.default_rng(6)
    for k in range(len(ls.TEMPLATES)):
        w = ls.TEMPLATES[k][1].split()
        for edits in (0, 1, 2):
            for _ in range(edits):
                at = int(rng.integers(0, len(w)))
                w[at : at + 1] = [["thing"], [], [w[at], "very"]][int(rng.integers(0, 3))]
            text = " ".join(["here", "and", *w, "or", "not"])
            want, got = slow_notices([ls.plain(x.encode()) for x in text.split()]), ls.notices(text.encode())
            assert ([want[3]] if want else []) == [x[0] for x in got][: 1 if want else 0] and len(got) <= 1, (text, want, got)


def test_license_tags_and_look_alikes():
    got = ls.notices(b"// SPDX-License-Identifier: Apache-2.0\n/* SPDX-License-Identifier: GPL-3.0-or-later */ SPDX-License-Identifier: Unknown-1.0")
    assert [x[0] for x in got] == ["Apache-2.0", "GPL-3.0"]
    assert ls.notices(b"This work is licensed under the GNU Quick General Affero Public License, version 3.") == []
    assert ls.notices(b"Licensed under CC BY-ND 4.0.") == []
    many = b" ".join([b"license words Released under the MIT License. and so on"] * 300)
    assert [x[0] for x in ls.notices(many)] == ["MIT"] * 300


def test_licenses(spark, odd, none):
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nMore words."),
        (2, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "A license plate is no license."),
        (5, None),
        (6, "Licensed under CC BY 4.0."),
    ]
    got = sorted((r["doc_id"], r["license"], rows[r["doc_id"] - 1][1].encode()[r["start_byte"] : r["end_byte"]].decode()) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", "Released under the MIT License."), (2, "Apache-2.0", "Licensed under the Apache License, Version 2.0."), (2, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), (3, "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), (6, "CC-BY-4.0", "Licensed under CC BY 4.0.")]
    assert ls.scan(odd).count() == 0 and ls.scan(none).count() == 0
    assert ls.wording("a b c d e f g h i j".split(), "a b c d e f g h i x".split())[2] == ["-j"]


SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    out = []
    for k, (kind, p) in enumerate(SLOW.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a.@-+1234 (0)é%"), max_size=40))
def test_patterns(text):
    assert pii.patterns(text) == slow_spans(text)


def test_patterns_on_whole_cases():
    text = "Ä me.x@y.example.com, 10.0.0.255, 256.1.1.1, 4111 1111 1111 1111, +1 (319) 555-5132, 1.2.3.4.5, a@b@c.de"
    assert pii.patterns(text) == slow_spans(text) and {k for k, _, _ in pii.patterns(text)} == {0, 1, 2, 3}
    assert pii.patterns("1" * 5000 + ".1.1.1") == []


def test_field_carries_labels_over_skip_edges():
    secret = "b7602ad27cf5550de1c"
    model = pii.trained()
    without = (*model[:2], model[2] * 0)
    plain = pii.field_spans([f"we saw {secret} there"], model)
    both = pii.field_spans([f"we saw {secret} there and far away password={secret} stood"], model)
    assert plain == [[]] and len(both[0]) == 2 and all(k == 4 for k, _, _ in both[0])
    for text, n in ((" ".join(["the password: zebrafish is", *["now zebrafish then"] * 50]), 51), (" ".join([*["now zebrafish then"] * 50, "the password: zebrafish is"]), 51), ("dial +1 (826) 555-4081 or just 555-4081 later", 2)):
        assert len(pii.field_spans([text], model)[0]) == n and len(pii.field_spans([text], without)[0]) == 1
    assert pii.field_spans(["see zebrafish here", "its number 4532015112830367 again 4532015112830367"], model) == [[], []]  # the number fails Luhn
    trimmed = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"*** end'
    assert [trimmed[a:b] for _, a, b in pii.field_spans([trimmed], model)[0]] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    assert pii.field_spans(["nothing but plain words here", ""], model) == [[], []]


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(2)
    u, t = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    t = (t + t.T) / 2
    got = pii.beliefs(u, np.array([[0, 1], [1, 2]]), t[None], np.zeros(2, int), rounds=30, damp=0.0)
    p = np.exp([[[u[0, a] + u[1, b] + u[2, c] + t[a, b] + t[b, c] for c in (0, 1)] for b in (0, 1)] for a in (0, 1)])
    for i, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        m = p.sum(axis=axes)
        g = np.exp(got[i] - got[i].max())
        assert g / g.sum() == pytest.approx(m / m.sum())


def test_pii_query_and_mask(spark, odd, none):
    rows = [(1, "Mail a.b@c.example.org or +1 (319) 555-5132 now"), (2, None), (3, ""), (4, 'x token = "0641917ea4e9feb9cda83477b57ac2654884f485" y')]
    df = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in slow_spans(rows[0][1]))
    assert got[1]["base"] == base == got[1]["spans"] and got[2]["spans"] == got[3]["spans"] == ""
    assert got[4]["spans"].startswith("secret:") and hashlib.sha256(base.encode()).hexdigest()
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask(df).collect()}
    assert masked[1] == ("Mail [EMAIL] or [PHONE] now", 27) and masked[2][0] is None and masked[4][0] == 'x token = "[SECRET]" y'
    assert pii.mask(odd).columns == odd.columns and pii.find(odd).count() == odd.count() and pii.find(none).count() == 0


@pytest.mark.parametrize(("score", "label", "threshold"), [(toxicity.toxic_scores, "toxic", 0.5), (quality_classifier.quality_scores, "quality", 0.3)])
def test_held_out_accuracy(spark, small, score, label, threshold):
    large = f"{small}/../sf0.1"
    docs, labels_ = table(spark, large, "documents"), table(spark, large, "labels")
    got = supervised.report(score(docs, labels_), threshold).where("held_out").join(labels_, "doc_id").select("predicted", label).collect()
    assert len(got) > 500 and sum(a == b for a, b in got) / len(got) > 0.95


@pytest.mark.parametrize("score", [toxicity.toxic_scores, quality_classifier.quality_scores])
def test_classifiers_on_odd_rows(spark, score, odd, none, labels):
    got = score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score(odd, labels.limit(0)).collect()} == {0.5}
    assert score(none, labels).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(3)
    x = [np.unique(np.concatenate([rng.integers(10, 200, 8), [i % 2]])) for i in range(80)]
    y = np.array([i % 2 for i in range(80)])
    m = quality_classifier.linear(x, y)
    assert all((quality_classifier.margin(f, m) > 0) == bool(c) for f, c in zip(x, y, strict=True))


def test_two_distances_decide_toxicity(spark, small):
    """Both dictionaries hold their class's text, held-out recall and specificity are both high, and swapped dictionaries find nothing."""
    large = f"{small}/../sf0.1"
    docs, labels_ = table(spark, large, "documents"), table(spark, large, "labels")
    model = toxicity.fit_toxicity(docs, labels_)
    assert len(model["toxic"]) == len(model["ordinary"]) > 8000 and min(len(set(model[c].split())) for c in ("toxic", "ordinary")) > 100
    for m, recall, specificity in ((model, 0.9, 0.97), (model | {"toxic": model["ordinary"], "ordinary": model["toxic"]}, None, None)):
        got = toxicity.scored(docs, m, toxicity.scorer).join(labels_, "doc_id").where(supervised.in_fold("doc_id") & labels_["toxic"].isNotNull()).select("score", "toxic").collect()
        hit = [r["score"] >= 0.5 for r in got if r["toxic"]]
        if recall:
            assert sum(hit) >= recall * len(hit) and sum(r["score"] < 0.5 for r in got if not r["toxic"]) >= specificity * sum(not r["toxic"] for r in got)
        else:
            assert sum(hit) < 0.2 * len(hit)


def test_short_words_and_phrases_can_be_toxic():
    """Grams run over word boundaries, so words of three letters and phrases of harmless words tell as well."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioustrnl"), int(rng.integers(3, 9))))
    vocabulary = [word() for _ in range(400)]

    def text(bad):
        w = [vocabulary[i] for i in rng.integers(0, 400, 60)]
        for at in rng.integers(0, 58, 3) if bad else ():
            w[at : at + 1] = (["zog", "kuk"], ["you", "rat", "you"], ["go", "a", "way"])[int(rng.integers(0, 3))]
        return " ".join(w).encode()

    y = np.arange(600) % 2
    model = toxicity.train([text(bad) for bad in y[:400]], y[:400])
    score = toxicity.scorer(model)
    assert np.mean([(score(text(bad)) >= 0.5) == bad for bad in y[400:]]) > 0.9


def test_distance_against_plain_compression(spark, labels, odd):
    model = toxicity.train([b"some words of the one kind " * 3, b"other words and vile filth here " * 3] * 40, np.arange(80) % 2)
    t, o = toxicity.compressor(model["toxic"]), toxicity.compressor(model["ordinary"])
    text = "Words of vile filth, and some words of the one kind. É".encode() * 3
    w = text.lower().split()
    want = [len(o.compress(toxicity.PRIMER + b" " + b" ".join(w[i : i + 8]) + b" ")) - len(t.compress(toxicity.PRIMER + b" " + b" ".join(w[i : i + 8]) + b" ")) for i in range(0, len(w), 8)]
    assert toxicity.distances(text, t, o).tolist() == want
    clash = odd.withColumn("toxic", toxicity.F.lit(1))
    kept = toxicity.drop_toxic(clash, model)
    assert kept.columns == clash.columns
    score = toxicity.scorer(model)
    assert kept.count() == sum(score((r["text"] or "").encode()) < 0.5 for r in odd.collect())


def test_drop_toxic_without_a_model(spark, odd):
    assert toxicity.drop_toxic(odd, None).columns == odd.columns


@pytest.mark.parametrize("n", [3, 700])
def test_block_index_finds_all_within_the_radius(n):
    rng = np.random.default_rng(n)
    known = rng.integers(0, 2**63, n).astype(np.uint64)
    index = dc.Index(entries={50: (known, np.arange(n), np.zeros(n, int))})
    prints = np.concatenate([known[rng.integers(0, n, 400)], rng.integers(0, 2**63, 400).astype(np.uint64)])
    for i in range(400):
        for b in rng.choice(64, int(rng.integers(0, 12)), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    at, of = dc.hits(prints, 50, index)
    want = np.nonzero(np.bitwise_count(prints[:, None] ^ known[None, :]) <= index.radius)
    assert sorted(zip(at.tolist(), of.tolist(), strict=True)) == list(zip(*(x.tolist() for x in want), strict=True))
