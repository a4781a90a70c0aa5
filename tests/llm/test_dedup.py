from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tesserae.llm import jaccard_join as J
from tesserae.llm import passages as P
from tests.oracle import check


def shingle_set(t):
    ws = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    ids = [r[0] for r in rows if r[0] is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(((i, len(shingle_set(t)), None if i is None else find(i)) for i, t in rows), key=repr)


def near_copies(seed, n=260):
    """Chains and groups of edited copies around the threshold, exact copies, and documents that share a passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(40))
    rows, base = [], [word() for _ in range(60)]
    for i in range(n):
        kind = rnd.randrange(6)
        if kind == 0:
            base = [word() for _ in range(rnd.randrange(1, 120))]
            t = " ".join(base)
        elif kind in (1, 2):
            w = list(base)
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
            if rnd.random() < 0.5:
                base = w
        elif kind == 3 and rows:
            t = rnd.choice(rows)[1]
        elif kind == 4:
            t = " ".join([word() for _ in range(rnd.randrange(0, 60))] + [passage] + [word() for _ in range(3)])
        else:
            t = " ".join(word() for _ in range(rnd.randrange(0, 9)))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    rows = near_copies(seed)
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "A b\x0bc"), (904, "a B c"), (None, "a b c"), (None, None), (5, rows[5][1]), (905, "w" * 100_000), (906, "é é é é é é"), (3, rows[9][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_shingles int, id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()), key=repr)
    assert got == brute(rows)


def test_prefix_and_needed_overlap_are_exact():
    for n in range(1, 200):
        for m in range(n, 260):
            least = next(i for i in range(0, n + m + 1) if 100 * i >= 80 * (n + m - i))
            assert J.needed(n, m) == least
            if least <= n:
                assert min(n, n - least + J.SHARED) <= J.prefix_size(n) and min(m, m - least + J.SHARED) <= J.prefix_size(m)


def test_signatures_skip_no_pair_that_links():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 71, 72, 73, 188, 190, 431, 433, 949, 951, 1200):
        s = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for change in (0, 0.05, 0.1, 0.13, 0.3, 1):
            t = s.copy()
            t[: round(n * change)] = rng.integers(0, 1 << 64, round(n * change), dtype=np.uint64)
            sets += [np.unique(t), np.unique(t[round(n * change / 2) :])]
    signs = [J.signature(s) for s in sets]
    width = np.array([len(g) for g in signs])
    rows = np.stack([np.append(g, np.zeros(J.WORDS - len(g), np.uint64)) for g in signs])
    x, y = (v.ravel() for v in np.indices((len(sets), len(sets))))
    n = np.array([len(s) for s in sets])
    may = J.may_link(n[x], n[y], rows[x], rows[y], width[x], width[y])
    links = np.array([100 * len(c := np.intersect1d(sets[i], sets[j])) >= 80 * (n[i] + n[j] - len(c)) and len(c) > 0 for i, j in zip(x, y, strict=True)])
    assert may[links].all() and links.sum() > len(sets) and (~may).sum() > len(x) / 4


def test_no_documents(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_against_sql(spark, small):
    check(spark, small, J.op10_jaccard_join, J.OP10_SQL)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_passages_are_found_and_clean_documents_left(spark):
    rnd = random.Random(4)
    shared = [words(rnd, n) for n in (51, 60, 75, 140)]
    rows = []
    for i in range(24):
        rows.append((i, (words(rnd, rnd.randrange(60, 90)) + rnd.choice(" \n") + shared[i % 4] + " " + words(rnd, rnd.randrange(60, 90))).strip()))
    rows += [(100 + i, words(rnd, 150)) for i in range(20)]
    line = words(rnd, 90).split()
    edited = list(line)
    edited[1] = "zzzzz"
    rows += [(200, words(rnd, 20) + "\n" + " ".join(line) + "\n" + words(rnd, 20)), (201, words(rnd, 20) + "\n" + " ".join(edited))]
    rows += [(300, None), (301, ""), (None, shared[0]), (302, "rep " * 400), (303, words(rnd, 3)), (304, words(rnd, 30) * 3)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, words int")
    found = P.find(df).collect()
    assert {r.id for r in found} == set(range(4, 24)) | {201}
    texts = dict(rows)
    for r in found:
        assert r.keeper < r.id
        if r.id < 24:
            cut = texts[r.id].encode()[r.begin : r.end].decode()
            assert " ".join(cut.split()) in " ".join(texts[r.keeper].split()) and len(cut.split()) >= P.RUN
    ranges = spark.createDataFrame([(r.id, r.begin, r.end) for r in found], "id long, begin long, end long")
    after = {r.doc_id: r.text for r in P.without(df.filter("doc_id is not null"), ranges).collect()}
    for i, t in rows:
        if i is not None and i not in {r.id for r in found}:
            assert after[i] == t
    assert all(len(after[i]) < len(texts[i]) for i in range(4, 24))


def test_copies_and_many_groups(spark):
    rnd = random.Random(8)
    t = words(rnd, 80)
    df = spark.createDataFrame([(i, t) for i in range(300)], "doc_id long, text string")
    found = P.find(df).collect()
    assert {r.id for r in found} == set(range(1, 300)) and {r.keeper for r in found} == {0} and {(r.begin, r.end) for r in found} == {(0, len(t))}


def test_cuts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "abc   def\n\nghi", 5, "x"), (2, None, 6, "y"), (None, "abc", 7, "z")], "doc_id long, text string, cuts int, cut_id string")
    got = P.without(df, spark.createDataFrame([(1, 6, 9)], "id long, begin long, end long"))
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {(1, "abc   ghi", 5, "x"), (2, None, 6, "y"), (None, "abc", 7, "z")}


def test_no_paragraphs(spark):
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert P.find(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).count() == 0


def test_members_of_a_band_that_its_smallest_does_not_link(spark):
    rnd = random.Random(3)
    base = words(rnd, 100).split()
    texts = []
    for _ in range(150):  # pairs of variants: the two alike by 0.9, those of different pairs by less than 0.7
        own = list(base)
        for k in rnd.sample(range(4, 96), 2):
            own[k] = words(rnd, 1)
        near = list(own)
        near[rnd.randrange(4, 96)] = words(rnd, 1)
        texts += [" ".join(own), " ".join(near)]
    rnd.shuffle(texts)
    want = {i for i, _, head in brute(list(enumerate(texts))) if i != head}
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, raw binary")
    assert len(want) >= 120 and {r.id for r in removed_lines(docs)} == want


def removed_lines(docs):
    rows = P.scan(docs).filter("spot >= 0").cache()
    paragraphs, members = P.colliding(rows)
    asked = paragraphs.join(members.select("digest").distinct(), "digest", "left_semi").selectExpr("id", "digest", "spot", *(f"cast(null as long) {n}" for n in ("word", "words", "keeper", "there")))
    return P.near_lines(rows, paragraphs, members, P.looked_up(docs, asked)).collect()


def test_a_group_of_near_copies_is_not_held_pair_by_pair(spark, monkeypatch):
    rnd = random.Random(21)
    base = words(rnd, 150).split()
    texts = []
    for _ in range(500):  # most pairs link, but no paragraph is like all others
        own = list(base)
        for k in rnd.sample(range(150), 2):
            own[k] = words(rnd, 1)
        texts.append(" ".join(own))
    rows, inner = {}, P.stored
    monkeypatch.setattr(P, "stored", lambda df, label: rows.setdefault(label, inner(df, label)) if label == "held" else inner(df, label))
    want = {i for i, _, head in brute(list(enumerate(texts))) if i != head}
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, raw binary")
    assert len(want) >= 490 and {r.id for r in removed_lines(docs)} == want
    per_band = rows["held"].groupBy("band", "component").count().collect()
    sizes = {}
    for r in per_band:
        sizes.setdefault(r.band, []).append(r["count"])
    assert sum((sum(v) ** 2 - sum(n * n for n in v)) // 2 for v in sizes.values()) < 20_000


def test_recall_of_similar_lines_by_brute_force(spark):
    rnd = random.Random(12)
    texts = []
    for n in (5, 6, 8, 9, 12, 20, 45, 80):
        for _ in range(25):
            base = words(rnd, n).split()
            texts.append(" ".join(base))
            for _ in range(4):
                t = list(base)
                for k in rnd.sample(range(n), rnd.randrange(0, max(2, n // 30 + 1))):
                    t[k] = words(rnd, 1)
                t = t[: n - rnd.randrange(0, 2)]
                texts.append("  ".join(t).title() if rnd.random() < 0.2 else " ".join(t))
    texts = [t for t in texts if len(t.split()) >= P.MIN_WORDS]
    rnd.shuffle(texts)
    want = {i for i, _, head in brute(list(enumerate(texts))) if i != head}
    found = {r.id for r in removed_lines(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, raw binary"))}
    assert found <= want and len(found) >= 0.98 * len(want) > 300


def test_a_removed_passage_stands_in_its_keeper(spark):
    rnd = random.Random(6)
    phrases = [words(rnd, 12) for _ in range(30)]
    texts = {i: " ".join(rnd.choice(phrases) for _ in range(10)) for i in range(60)}
    found = P.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert found and all(texts[r.id][r.begin : r.end].strip() in texts[r.keeper] and r.keeper < r.id for r in found)
    assert all(r.words == len(texts[r.id][r.begin : r.end].split()) for r in found)


def test_passages_go_to_their_true_ends(spark):
    rnd = random.Random(9)
    shared = [words(rnd, n).split() for n in (51, 52, 60, 75, 140) for _ in range(8)]
    rows, want = [], {}
    for i, p in enumerate(shared):
        rows.append((i, f"{words(rnd, 70)} {' '.join(p)} {words(rnd, 70)}"))
        head, body = words(rnd, 70) + " ", (" ", "      ", "\r\n\r\n    ")[i % 3].join(p)
        rows.append((100 + i, f"{head}{body} {words(rnd, 70)}"))
        want[100 + i] = (len(head), len(head) + len(body), len(p), i)
    found = P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: (r.begin, r.end, r.words, r.keeper) for r in found} == want and len(found) == len(want)


def test_short_and_wrapped_paragraphs(spark):
    rnd = random.Random(10)
    short, long = words(rnd, 12), words(rnd, 60).split()
    edited = long[:30] + ["zzzzz"] + long[31:]
    wrap = lambda ws, n: "\n".join(" ".join(ws[k : k + n]) for k in range(0, len(ws), n))
    rows = [(1, f"{words(rnd, 9)}\n{short}\n{words(rnd, 9)}"), (2, f"{words(rnd, 30)}\n{short}\n{words(rnd, 30)}")]
    rows += [(3, f"{words(rnd, 9)}\n \n{wrap(long, 12)}\n\n{words(rnd, 9)}"), (4, f"{words(rnd, 9)}\n\n{wrap(edited, 10)}\n\n{words(rnd, 9)}")]
    texts = dict(rows)
    found = P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, texts[r.id][r.begin : r.end], r.words, r.keeper) for r in found} == {(2, short, 12, 1), (4, wrap(edited, 10), 60, 3)}


def test_texts_of_a_chunk_are_cut_as_each_alone():
    rnd = np.random.default_rng(4)
    sizes = [0, 1, 17, 18, 19, 30, 0, 400, 18, 2, 90, 17]
    for kinds in (3, 1 << 60):
        hashes = P.W.mix(rnd.integers(0, kinds, sum(sizes)).astype(np.uint64))
        at = np.cumsum([0, *sizes])
        want = []
        for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if hi - lo >= P.RUN:
                cut = np.append(P.anchors(hashes[lo:hi]), hi - lo)
                for start in cut[:-1]:
                    if len(end := cut[cut >= start + P.RUN]):
                        want.append((k, start, end[0] - start, P._range_hashes(hashes[lo:hi], cut[cut == start], end[:1]).view(np.int64)[0]))
        doc, h, start, size = P._runs(hashes, at)
        assert list(zip(doc, start, size, h, strict=True)) == want and len({k for k, *_ in want}) == 6


def test_few_pairs_take_no_rounds_of_leaders(spark, monkeypatch):
    """Each round joins all sets twice, which costs more than the pairs it spares where bands are small."""
    rnd = random.Random(31)
    labels, inner = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, label: labels.append(label) or inner(df, label))
    texts = []
    for _ in range(30):
        base = words(rnd, 40).split()
        for _ in range(4):
            own = list(base)
            own[rnd.randrange(40)] = words(rnd, 1)
            texts.append(" ".join(own))
    want = {i for i, _, head in brute(list(enumerate(texts))) if i != head}
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, raw binary")
    assert {r.id for r in removed_lines(docs)} == want
    assert "held" in labels and "led" not in labels


def test_rounds_of_leaders_end_once_they_spare_no_pairs(spark, monkeypatch):
    """Variants of which each is like one other only: a leader brings few of a band together, so one round is all that is tried."""
    rnd = random.Random(3)
    base, texts = words(rnd, 100).split(), []
    for _ in range(150):
        own = list(base)
        for k in rnd.sample(range(4, 96), 2):
            own[k] = words(rnd, 1)
        near = list(own)
        near[rnd.randrange(4, 96)] = words(rnd, 1)
        texts += [" ".join(own), " ".join(near)]
    labels, inner = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, label: labels.append(label) or inner(df, label))
    want = {i for i, _, head in brute(list(enumerate(texts))) if i != head}
    assert {r.id for r in removed_lines(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, raw binary"))} == want
    assert labels.count("led") == 1


def test_runs_and_bands_are_shuffled_once(spark):
    rows = P.scan(spark.createDataFrame([(i, b"some words of a text " * 9) for i in range(4)], "id long, raw binary"))
    plan = P.places(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(h#") == 1


def test_words_in_common_as_counted_one_by_one():
    rnd = random.Random(2)
    texts = lambda: b"".join(rnd.choice([b"ab", b"AB", b"\xc3\xa9", b"c", b" ", b" \n", b"\t\x0b", b" "]) for _ in range(rnd.randrange(0, 40)))
    pairs = [(texts(), texts()) for _ in range(300)]
    pairs += [(x := texts(), rnd.choice([x.upper(), b"zz " + x, x + b" zz"])) for _ in range(300)] + [(b"", b""), (b" ", b"a")]
    own, there = (P.pa.array(c, P.pa.binary()) for c in zip(*pairs, strict=True))
    for back in (False, True):
        n, span = P._common(own, there, 7, back)
        for k, (a, b) in enumerate(pairs):
            x, y = (t.lower().split()[:: -1 if back else 1][:7] for t in (a, b))
            same = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))  # noqa: B905
            cut = 0
            if same and back:
                rest = a.rsplit(None, same)
                cut = len(a[len(rest[0]) if len(rest) > same else 0 :].lstrip())
            elif same:
                rest = a.split(None, same)
                cut = len(a[: len(a) - len(rest[same]) if len(rest) > same else None].rstrip())
            assert (n[k], span[k]) == (same, cut)


def test_ranges_of_a_document_are_disjoint_and_count_their_words(spark):
    """Rows that overlap, nest and touch, in documents that share an Arrow batch."""
    rnd = random.Random(14)
    lines = [words(rnd, n) for n in (8, 9, 12, 30, 60)]
    texts = {i: "\n".join(rnd.choice(lines + [words(rnd, 7)]) for _ in range(rnd.randrange(1, 9))) + "\n\n" * rnd.randrange(2) for i in range(80)}
    found = P.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len({r.id for r in found}) > 60
    for i, t in texts.items():
        at = 0
        for r in sorted((r for r in found if r.id == i), key=lambda r: r.begin):
            assert at <= r.begin < r.end <= len(t) and r.keeper < i and r.words == len(t[r.begin : r.end].split())
            at = r.end
