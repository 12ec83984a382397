"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat, decontaminate, jaccard, language, mixer, mixing, quality, substring, urls, warc
from tideline.llm.common import Scratch, fresh

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sig long, h long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(7)
    vocabulary = [a + b for a in ("ba", "tor", "mi", "ge", "lun", "sha") for b in ("n", "ter", "lo", "vi", "kar", "des", "pu")]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = make(200), make(70)
    near = base[:]
    near[50] = "changed"
    out = [" ".join(base), " ".join(base), " ".join(near), None, "", " \t\n", "one two", "one two", "One TWO", " ".join([*make(60), *passage, *make(30)]), " ".join([*make(20), *passage]), "na " * 300, " ".join(make(3000)), "same line\nsame line\n\nother line", "# $ % " * 40]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, 0, "x", 1, 2) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_jaccard(docs, none):
    sets = {}
    for i, t in texts():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r[0]: (r[1], r[2]) for r in jaccard.similarity_classes(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}
    assert jaccard.similarity_classes(none).count() == 0


def test_jaccard_near_copies_across_classes(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(80):
        w = base[:]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r[0]: r[2] for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == label


def _brute_classes(rows):
    """Class ids by brute force: the least id (nulls aside) of each set of rows that links join."""
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return collections.Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def _copies(n, seed, edits):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(rng.randrange(*edits)):
            w[rng.randrange(len(w))] = f"x{i}{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [{}, {"HOT": 0}, {"HELD": 16, "SLICE": 9}])
def test_jaccard_repeated_and_null_ids(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    near = _copies(60, 3, (1, 9)) + _copies(60, 8, (1, 9))
    rows = [(i % 50, t) for i, t in enumerate(near)] + [(None, near[0] + " tail"), (None, near[1]), (None, "so few"), (7, "so few"), (7, None), (None, None), (None, "")]
    rows += [(3, near[9])] * 3
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(tuple(r) for r in got) == _brute_classes(rows)


def test_jaccard_returns_links_not_pairs():
    """A group of m members gives m - 1 links at most, and as many classes as brute force."""
    import numpy as np

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(1500):
        s = np.ones(400, bool)
        s[rng.choice(400, rng.integers(0, 60), replace=False)] = False
        sets.append((s, rng.integers(1 << 20, 1 << 21, rng.integers(0, 40)).astype(np.uint64)))
    sets = [(s, np.unique(a)) for s, a in sets]
    n = np.array([s.sum() + len(a) for s, a in sets])
    far = np.array([(~s).sum() + len(a) for s, a in sets])
    made = jaccard.forest(n.astype(np.int64), far.astype(np.int64), np.arange(1500), None, [np.packbits(~s).tobytes() for s, _ in sets], [a.tobytes() for _, a in sets])
    label = list(range(1500))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    dense = np.array([s for s, _ in sets])
    for i, j in made:
        both = (dense[i] & dense[j]).sum() + len(np.intersect1d(sets[i][1], sets[j][1]))
        assert 9 * both >= 4 * (n[i] + n[j]) and root(i) != root(j)
        label[root(i)] = root(j)
    same = dense.astype(np.int32) @ dense.T.astype(np.int32)
    for i in range(1500):
        for j in np.flatnonzero(9 * (same[i] + np.minimum(40, n[i])) >= 4 * (n[i] + n)):
            if root(i) != root(int(j)):
                both = same[i, j] + len(np.intersect1d(sets[i][1], sets[j][1]))
                assert 9 * both < 4 * (n[i] + n[j])


@pytest.mark.parametrize("group", [500, 1])
def test_substring(docs, none, group, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", group)
    first = {}
    for i, t in texts():
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t in texts():
        w = words(t)
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone).encode())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring.dedup_substrings(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 200
    assert substring.dedup_substrings(none).count() == 0


def _brute_cut(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                first.setdefault(tuple(w[k : k + 50]), set()).add(i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 49) if i is not None and min(first[tuple(w[k : k + 50])]) < i for j in range(k, k + 50)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone).encode()))
    return collections.Counter(out)


@pytest.mark.parametrize("group", [500, 3])
def test_substring_hot_passages(spark, group, monkeypatch):
    """A passage in many documents, at their edges and inside, cut short in some; repeated rows, ids and nulls."""
    monkeypatch.setattr(substring, "GROUP", group)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(75)]
    own = lambda i, n: [f"o{i}{rng.randrange(1000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        a, b = rng.randrange(0, 20), rng.randrange(55, 76)
        rows.append((rng.randrange(50), " ".join(own(i, rng.randrange(0, 30)) + passage[a:b] + own(i, rng.randrange(0, 30)))))
    rows += [(7, " ".join(passage + own(99, 5) + passage))] * 3 + [(None, " ".join(passage)), (None, None), (3, None), (70, " ".join(passage)), (71, "na " * 200), (72, "na " * 120)]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == _brute_cut(rows)


def test_substring_contexts_of_repeated_rows(spark, tmp_path, monkeypatch):
    """k equal rows give contexts in proportion to k."""
    seen = []

    class Counting(Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            if name == "contexts":
                seen.append(out.count())
            return out

    text = " ".join(f"w{k}" for k in range(400))
    for k in (5, 40):
        docs = spark.createDataFrame([(1, text)] * k + [(2, text)] * k, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text"))
        substring.covered_ranges(docs, Counting(spark)).count()
    assert seen[1] == 8 * seen[0] > 0


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.judge(docs, ["doc_id"]).collect()}
    for i, t in texts():
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = collections.Counter(grams)
        repeat = len({j for k, g in enumerate(grams) if count[g] > 1 for j in range(k, k + 3)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none, ["doc_id"]).count() == 0


def _references(docs):
    found = quality.candidates(docs)
    base = quality.measured(docs, found, ["doc_id"])
    return base, quality.references(base, found)


def test_quality_references_of_every_language(spark, monkeypatch):
    rng = random.Random(2)
    make = lambda k: " ".join(rng.choice([f"f{k}{x}" for x in "abcd"]) if rng.random() < 0.5 else f"thing{rng.randrange(10**6)}" for _ in range(80))
    rows = [(10 * k + i, make(k), f"l{k:02}") for k in range(40) for i in range(1 if k == 39 else 2)]
    rows += [(1000, " ".join(f"x{i}y" for i in range(80)), "l01"), (1001, None, "l01"), (1002, make(7), None)]
    docs = Scratch(spark).keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    joined = {r["doc_id"]: r for r in quality.judge(docs, ["doc_id"]).collect()}
    assert {i for i, r in joined.items() if not r["kept"]} == {1000, 1001}
    few = docs.where("lang in ('l07', 'l39') or doc_id > 1000")
    inline = {r["doc_id"]: r for r in quality.judge(few, ["doc_id"]).collect()}
    monkeypatch.setattr(quality, "LANGUAGES", 0)
    joined = {r["doc_id"]: r for r in quality.judge(few, ["doc_id"]).collect()}
    assert len(joined) == 5 and inline.keys() == joined.keys()
    for i, r in joined.items():
        assert [pytest.approx(x) for x in r] == list(inline[i])
    base, refs = _references(docs)
    assert {r["kept"] for r in quality.verdicts(base, refs.where("lang <> 'l39'"), ["doc_id"]).where("doc_id = 390").collect()} == {True}


def _scripts():
    rng = random.Random(6)
    common = {
        "ru": "и в не на что он как это но по из за так же от".split(),
        "zh": "的 了 在 是 我 有 和 就 不 人 都 一 上 也".split(),
        "ko": "그리고 하지만 그래서 있는 하는 에서 으로 그런 대한 위한 있다 없는".split(),
        "en": "the of and to in that was with have from which their been would".split(),
    }
    letters = {"ru": "абвгдежзиклмнопрст", "zh": "山水火木金土日月年时分秒", "ko": "가나다라마바사아자차", "en": "abcdefghijklmnop"}
    made = lambda k: " ".join(rng.choice(common[k]) if rng.random() < 0.35 else "".join(rng.choices(letters[k], k=rng.randrange(2, 8))) + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(60, 160)))
    rows = [(100 * j + i, made(k), k) for j, k in enumerate(common) for i in range(40)]
    rows += [(900 + j, "".join(rng.choices("#$%&*<>|", k=4)).join(made(k).split()[:20] * 4), k) for j, k in enumerate(common)]
    rows += [(950, " ".join("".join(rng.choices("xyz0123456789", k=6)) for _ in range(90)), "en"), (951, "", "ru"), (952, None, None)]
    return rows


def test_quality_keeps_every_script(spark):
    docs = Scratch(spark).keep(spark.createDataFrame(_scripts(), "doc_id long, text string, lang string"), "docs")
    kept = {r["doc_id"] for r in quality.judge(docs, ["doc_id"]).where("kept").collect()}
    assert all(len([i for i in kept if i // 100 == j]) >= 39 for j in range(4)) and not {i for i in kept if i >= 900}


def _plain_verdicts(rows):
    """Of (id, text, lang) rows: (good, (share, common, classes, enough)) of the best reference or None, and base_failed; counting all words."""
    fit, stats = [], []
    for _, t, k in rows:
        t = t or ""
        w = words(t)
        n = len(re.findall(r"[#*$%&|<>]", t))
        chars = sum(map(len, w))
        counts = [len(re.findall("[A-Z]", t)), len(re.findall("[0-9]", t)), len(t) - chars, n, len(re.findall(r"[.,;:!?\"'()\[\]{}]", t)), len(t.encode()) - len(t)]
        shares = [x / max(len(t), 1) for x in [max(len(t) - sum(counts), 0), *counts]]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = collections.Counter(grams)
        repeat = len({j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 3)})
        stats.append((w, shares, len(w) < 50 or 100 * repeat > 50 * len(w)))
        if k and len(w) >= 50 and n * 50 < chars:
            fit.append((k, w, shares))
    refs = {}
    for k in {k for k, *_ in fit}:
        own = [(w, s) for x, w, s in fit if x == k]
        c = collections.Counter(x for w, _ in own for x in w)
        top = sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]
        n, total = sum(v for _, v in top), sum(c.values())
        if n / total * quality.MIN_WORDS * quality.LEAST_COMMON >= 1:
            refs[k] = ([x for x, _ in top], [v / n for _, v in top], n / total, [sum(s[j] for _, s in own) / len(own) for j in range(7)])

    def jsd(p, q):
        part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
        return sum(0.5 * (part(x, (x + y) / 2) + part(y, (x + y) / 2)) for x, y in zip(p, q))

    out = []
    for (_, _, k), (w, shares, failed) in zip(rows, stats):
        best = None
        for top, own, share, classes in refs.values():
            c = collections.Counter(w)
            found = [c[x] for x in top]
            total = sum(found)
            if total:
                enough = total >= quality.MIN_COMMON_WORDS
                v = (total / len(w) / share, jsd([x / total for x in found], own) if enough else 1.0, jsd(shares, classes), enough)
                good = v[2] <= quality.MOST_CLASS and v[0] >= quality.LEAST_COMMON and (not enough or v[1] <= quality.MOST_COMMON)
                best = max(best or (good, v), (good, v))
        kept = not failed and (not refs or bool(best and best[0]) or (k is not None and k not in refs))
        out.append((kept, best and best[1]))
    return out


def test_quality_verdict_by_brute_force(spark):
    rows = _scripts()
    docs = Scratch(spark).keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    want = dict(zip([r[0] for r in rows], _plain_verdicts(rows)))
    for r in quality.judge(docs, ["doc_id"]).collect():
        kept, best = want[r["doc_id"]]
        assert r["kept"] == kept, r
        if best:
            assert r["common_share"] == pytest.approx(best[0]) and r["class_divergence"] == pytest.approx(best[2], abs=1e-12)


def test_quality_common_words_of_any_script(spark):
    rng = random.Random(4)
    made = lambda common, share: " ".join(rng.choice(common) if rng.random() < share else f"\u0915\u0924{rng.randrange(10**6)}\u092e" for _ in range(80))
    rows = [(i, made(["\u0939\u0948\u0902", "\u092e\u0947\u0902", "\u0915\u0947"], 0.4), "hi") for i in range(20)]
    rows += [(100 + i, made(["-"], 0.01), "rare") for i in range(20)]  # nothing common: no reference
    rows += [(200 + i, "zz " * 30, "hi") for i in range(100)] + [(300, made(["-"], 0), "hi")]
    docs = Scratch(spark).keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    base, refs = _references(docs)
    (ref,) = refs.collect()
    assert ref["lang"] == "hi" and set(ref["words"][:3]) == {"\u0939\u0948\u0902", "\u092e\u0947\u0902", "\u0915\u0947"} and "zz" not in ref["words"]
    assert {r["doc_id"] for r in quality.verdicts(base, refs, ["doc_id"]).collect() if r["kept"]} == {*range(20), *range(100, 120)}


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (i % 9), ["x", "y", "z", None][i % 4]) for i in range(400)] + [(5, "w " * 5, "y")] * 3
    sized = mixing.numbered(mixing.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    got = mixing.mix(sized).collect()
    assert len(got) == 403 and all(0 <= r["copies"] <= 2 for r in got)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 9 for r in got)
    assert sorted(map(str, mixing.mix(sized).collect())) == sorted(map(str, got))
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 45) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.mix(mixing.numbered(mixing.sizes(none))).count() == 0
    assert mixing.mix(mixing.numbered(mixing.sizes(docs))).count() == len(texts())


def test_mixing_targets_of_many_sources(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(60):02}" if k % 50 else None, rng.choice([0, 1, 5, 40, 900])) for k in range(300)] + [("empty", 0)]
    sized = spark.createDataFrame(rows, "source string, size long")
    want = sorted((str(r["source"]), r["source_size"], r["target"]) for r in mixing.targets(sized).collect())
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 3)
    got = sorted((str(r["source"]), r["source_size"], r["target"]) for r in mixing.targets(sized).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert sum(t for *_, t in got) == pytest.approx(1.5 * sum(s for _, s in rows))
    assert mixing.targets(sized.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", -1)
    assert mixing.targets(sized.limit(0)).count() == 0


def test_mixing_keeps_expectations(spark, monkeypatch):
    """Over many seeds every document is taken as often as its rate says, and a source's words stay near its target."""
    group = __import__("pandas").DataFrame({"doc_id": range(40), "row": range(40), "p": [0.3] * 40, "size": [float(1 + k % 7) for k in range(40)]})
    taken, left = collections.Counter(), 0.0
    for seed in range(400):
        monkeypatch.setattr(mixing, "SEED", seed)
        words = 0.0
        for k, p, settled in mixing._round(group, 0):
            taken[k] += p
            words += p * group["size"][k]
            assert not settled or p in (0.0, 1.0)
        assert words == pytest.approx(0.3 * group["size"].sum())
    assert all(abs(taken[k] / 400 - 0.3) < 0.12 for k in range(40))


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "A train leaves at 60 km per hour and then Bob walks over 12 miles to the old station near the river"), (2, None), (3, "")], "item_id long, text string")
    same = "so A train leaves at 75 km per hour and then Alice walks over 9 miles to the old station near the river today"
    mixed = "so A train leaves at 12 km per hour and then Alice walks over 12 miles to the old station near the river today"
    found = decontaminate.matches(spark.createDataFrame([(1, same), (2, mixed), (3, "nothing of this kind"), (4, None)], "doc_id long, text string"), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 1)]
    assert decontaminate.matches(docs, items).count() == 0 and decontaminate.matches(none, items).count() == 0


def _brute_found(docs, items):
    """Benchmark items found in documents, by plain Python: the three forms of an item, windows, alignments, consistent slots."""
    edge = ".,;:!?\"'()[]{}"

    def template(text):
        raw = [(m.group(), m.start()) for m in WORD.finditer(text or "")]
        out = []
        for k, (w, at) in enumerate(raw):
            x = w
            for _ in range(3):
                x = x[1:] if len(x) > 1 and x[0] in edge else x
                x = x[:-1] if len(x) > 1 and x[-1] in edge else x
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            fresh = k == 0 or raw[k - 1][0][-1] in ".!?:" or text[at - 1] == "\n"
            number = x[0] in "0123456789" or (len(x) > 1 and x[1] in "0123456789" and x[0] in "-$+")
            kind = "num" if number else "unit" if k and out[-1][0] == "num" and not fresh and low in decontaminate.UNITS else "name" if "A" <= x[0] <= "Z" and not fresh else None
            out.append((kind, low))
        return out

    def windows(form, size, plain):
        key = lambda x: ("lit", x[1]) if plain or x[0] is None else (x[0], None)
        ok = lambda k: plain or size < 8 or 2 * sum(x[0] is None for x in form[k : k + size]) >= size
        return {k: tuple(map(key, form[k : k + size])) for k in range(len(form) - size + 1) if ok(k)}

    found = set()
    for item, text in items:
        t = template(text)
        if not t:
            continue
        size = min(8, len(t))
        forms = [(t, False), (t, True)]
        if t[0][0] is None and text.lstrip(" \t\n" + edge)[:1].isupper():
            forms.append(([("name", t[0][1]), *t[1:]], False))
        for form, plain in forms:
            if not plain and size < 8 and 2 * sum(x[0] is None for x in form) < size:
                continue
            mine = windows(form, size, plain)
            for row, (doc, body) in enumerate(docs):
                d = template(body)
                at = collections.defaultdict(list)
                for k, x in (windows(d, size, plain) if size == 8 else {k: tuple(("lit", y[1]) if plain or y[0] is None else (y[0], None) for y in d[k : k + size]) for k in range(len(d) - size + 1)}).items():
                    at[x].append(k)
                starts = collections.defaultdict(set)
                for k, x in mine.items():
                    for p in at[x]:
                        starts[p - k].add(k)
                covered = set()
                for s, ks in starts.items():
                    pairs = {(form[k + j][1], d[s + k + j][1]) for k in ks for j in range(size) if not plain and form[k + j][0]}
                    if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                        covered |= ks
                if mine and len(covered) >= decontaminate.SHARE * len(mine):
                    found.add((doc, item))
    return found


def test_decontaminate_by_brute_force(spark, none):
    rng = random.Random(9)
    vocabulary = "river old station near market train walks farmer sells apples bread price total how many does the of and with after before small large city".split()

    def question():
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(["Alice", "Bob", "Rome", "12", "3.5", "$40", "7 km", "900 grams"])
        return (" ".join(w)).capitalize() + "?"

    items = [(i, question()) for i in range(40)] + [(90, None), (91, ""), (92, "Paris"), (0, "What is the capital of France?")]
    other = lambda t: re.sub("Alice", "Carol", re.sub("Bob", "Dave", re.sub(r"\b12\b", "75", t)))
    docs = []
    for i, (_, t) in enumerate(items):
        t = t or "nothing"
        pad = lambda: " ".join(rng.choice(vocabulary) for _ in range(12))
        docs += [(10 * i, f"{pad()}, {t} {pad()}"), (10 * i + 1, f"{pad()}. {other(t)}"), (10 * i + 2, t.upper()), (10 * i + 3, pad()), (10 * i + 4, " ".join(rng.sample(t.split(), len(t.split()))))]
    docs += [(None, items[3][1]), (10, items[4][1]), (10, pad()), (5, None), (6, ""), docs[0], docs[0]]
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")))
    found = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert set(found) == _brute_found(docs, items) and len(found) == len(set(found)) > 100
    assert decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), none.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_language(spark, none):
    rng = random.Random(1)
    kinds = {"aa": ["thorin", "belgar", "the", "and"], "bb": ["mucho", "estado", "el", "una"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=80)), k) for i in range(60) for k in kinds]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame([(1, "the belgar and thorin the and thorin belgar"), (2, "el estado una mucho mucho el"), (3, None), (4, "12 34")], "doc_id long, text string"), model, "doc_id").collect()}
    assert got == {1: "aa", 2: "bb", 3: "und", 4: "und"}
    assert language.train(none) == {} and language.predict(none, {}, "doc_id").count() == 0


def test_language_on_held_out_documents(spark):
    """Accuracy on documents that were not learned from; repeated rows, null ids and clashing columns change nothing."""
    out = language.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held) > 100 and all(0 <= r["score"] <= 1 for r in held)
    rows = spark.createDataFrame([(None, "el estado una", "x", 0.5)] * 3, "doc_id long, text string, lang_pred string, score double")
    model = {"es": b"el estado una mucho el la de los " * 40, "en": b"the state of a many that it was " * 40}
    assert [(r["doc_id"], r["lang_pred"]) for r in language.predict(rows, model, "doc_id").collect()] == [(None, "es")] * 3


def test_language_by_brute_force(spark):
    """Every prediction is the smallest compression, by a plain loop."""
    import zstandard

    rng = random.Random(2)
    model = {k: " ".join("".join(rng.choices(v, k=rng.randrange(2, 9))) for _ in range(3000)).encode() for k, v in (("a", "etaoin"), ("b", "shrdlu"), ("c", "cmfwyp"))}
    made = [" ".join("".join(rng.choices(rng.choice(["etaoin", "shrdlu", "cmfwyp", "etashr"]), k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["Et 12, AO!", "t" * 100_000]

    def plain(t):
        raw = "".join(c for c in t.lower() if not c.isdigit() and c.isalnum() or c == " ").encode()
        sizes = {}
        for k, d in model.items():
            lead = b"" if len(raw) >= language.SHORT else d[-language.SHORT :]
            press = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[k] = len(press.compress(lead + raw))
        return min(sorted(sizes), key=sizes.get)

    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(rows, model, "doc_id").collect()}
    assert got == {i: plain(t) for i, t in enumerate(made)}


def _plain_scores(rows):
    """score of (text, train) rows by plain loops over tokens; only spellings and the places where segments start come from the
    operator's functions."""
    import numpy as np

    token = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    docs = []
    for t, f in rows:
        x = token(t)
        start = set(mixer.Piece([mixer.normal((t or "").encode())]).start.tolist())
        cuts = [*sorted(start), len(x)]
        docs.append((x, f, [(tuple(x[max(a - 2, 0) : a]), a, tuple(x[a:z])) for a, z in zip(cuts, cuts[1:])]))
    c, grams = collections.Counter(), collections.defaultdict(collections.Counter)
    for x, f, parts in docs:
        if f:
            c.update(x)
            for h, _, seg in parts:
                grams[h][seg] += 1
    tables = [np.zeros(2 * n, np.uint32) for n in mixer.CONTEXTS.values()]
    mixer.count([w.encode() for w in c if c[w] == 1], tables)
    spelling = [(mixer.logits(t), mixer.gates(t)) for t in tables]
    spelt = lambda w: float(mixer.word_scores([w.encode()], spelling)[0])
    cells = np.zeros((mixer.SHAPE[0] * mixer.SHAPE[1], 2))
    cell = lambda n, m: int(mixer._bin(np.array([n]), np.array([m]))[0])
    for g in grams.values():
        n, m = sum(g.values()), len(g)
        for v in g.values():
            if v > 1:
                cells[cell(n - 1, m), 1] += v
            elif n > 1:
                cells[cell(n - 1, m - 1), 0] += 1
    total = sum(c.values())
    new = min(max(sum(v == 1 for v in c.values()) / total, 1e-4), 0.9) if total else 1.0
    logit = lambda x: math.log((sum(x) + 0.5) / (len(x) - sum(x) + 0.5))
    bits = lambda v, least: min(max(math.frexp(v)[1] - least, 0), mixer.GATES - 1)

    class Mixer:
        def __init__(self, name):
            self.w, self.held = collections.defaultdict(lambda: list(mixer.START[name])), []

        def mix(self, a, b, x, gate):
            """a: a probability, b: a logarithm."""
            if len(self.held) == mixer.BLOCK:
                for g, e, y in self.held:
                    self.w[g] = [v + mixer.RATE * e * z for v, z in zip(self.w[g], y)]
                self.held = []
            x = [*x, 1.0]
            w = 1 / (1 + math.exp(-min(max(sum(map(lambda u, v: u * v, self.w[gate], x)), -9), 9)))
            one, other = math.log(w * a) if a else -math.inf, math.log(1 - w) + b
            p = max(one, other) + math.log1p(math.exp(-abs(one - other)))
            self.held.append((gate, math.exp(one - p) - w, x))
            return p

    out = []
    for x, f, parts in docs:
        own = collections.Counter(x) if f else {}
        mine = collections.defaultdict(collections.Counter)
        for h, _, seg in parts if f else ():
            mine[h][seg] += 1
        low, high, so_far, worth, hits, score, costs = Mixer("C"), Mixer("A"), collections.Counter(), [], [], 0.0, []
        for k, w in enumerate(x):
            known = c[w] - own.get(w, 0)
            word = math.log((1 - new) * known / total) if known > 0 else math.log(new) + spelt(w)
            share = so_far[w] / max(k, 1)
            prior = min(max(mixer.CACHE * k / (k + mixer.WARM), 1e-3), 0.5)
            p = low.mix(share, word, [math.log(prior / (1 - prior)), logit(worth[-16:]), logit(worth[-128:])], bits(k / 16, 0))
            costs.append(p if k else word)
            worth.append(share / (share + math.exp(word)))
            so_far[w] += 1
        for h, at, seg in parts:
            p = sum(costs[at : at + len(seg)])
            g, m = grams.get(h, {}), mine[h]
            seen = sum(g.values()) - sum(m.values())
            if seen > 0:
                many = max(len(g) - sum(g[v] == n for v, n in m.items()), 1)
                right = g.get(seg, 0) - m.get(seg, 0)
                z = cells[cell(seen, many)]
                p = high.mix(right / seen, p, [math.log((z[1] + 0.5) / (z[0] + 0.5)), logit(hits[-4:]), logit(hits[-16:])], bits(seen, 1))
                hits.append(float(right > 0))
            score += p
        out.append(score / math.log(10))
    return out


def test_mixer(spark, docs, none):
    train = docs.withColumn("train", F.col("doc_id") % 3 != 0)
    token = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = collections.Counter(x for i, t in texts() if i % 3 for x in token(t))
    n, v = sum(c.values()), len(c)
    one = spark.createDataFrame(train.select("doc_id", "text", "train").collect(), "doc_id long, text string, train boolean").coalesce(1)
    want = dict(zip([i for i, _ in texts()], _plain_scores([(t, i % 3 != 0) for i, t in texts()])))
    for r in mixer.score_documents(one).collect():
        x = token(dict(texts())[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(c[y] > 0 for y in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[y] + 0.5) / (n + 0.5 * (v + 1))) for y in x))
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6)
    assert mixer.score_documents(none.withColumn("train", F.lit(True))).count() == 0
    bare = mixer.score_documents(docs.withColumn("train", F.lit(False))).collect()
    assert len(bare) == len(texts()) and all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in bare)


def test_mixer_scores_do_not_depend_on_dealing(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(200)]
    rows = [(i % 40 if i % 7 else None, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 90))), i % 4 != 0) for i in range(120)]
    rows += [(1, "same text " * 30, True)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    key = lambda df: sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["train"]) for r in df.collect())
    whole = mixer.score_documents(docs.coalesce(1))
    cut = mixer.score_documents(docs.repartition(5))
    assert key(whole) == key(cut)
    # spellings are counted by piece, all else is exact: no unknown words here
    assert sorted(round(r["score"], 4) for r in whole.where("n_known = n_tokens").collect()) == pytest.approx(sorted(round(r["score"], 4) for r in cut.where("n_known = n_tokens").collect()), rel=1e-2)


def test_mixer_beats_the_base_score_on_held_out_documents(spark):
    out = mixer.op3_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > 0.9 * out["b"]


def _plain_follow(m, x, gate, near, spot, doc, bit, a, b):
    """Logarithms of the probabilities of steps, by plain loops: m's weights and map, and what each document adds to them."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda p: math.log(p / (1 - p))
    out, now, rank = [], None, 0
    for i, d in enumerate(doc):
        if d != now:
            now, rank, own, hit, every, held, edge, wide = d, 0, collections.Counter(), collections.Counter(), collections.Counter(), [], m.block, m.block
        if rank == edge:
            n = collections.Counter(h[0] for h in held)
            for cell, error, y, seen, bins in held:
                for k, v in enumerate(y):
                    own[k, cell] += mixer.RATE * error * min(1, mixer.BLOCK / n[cell]) * v
                for where, much in bins:
                    hit[where] += much * seen
                    every[where] += much
            held, wide = [], min(wide if rank == m.block else 2 * wide, mixer.WIDE * m.block)
            edge += wide
        y = [*(v[i] for v in x), 1.0]
        z = min(max(sum((m.weights[k, gate[i]] + own[k, near[i]]) * v for k, v in enumerate(y)), -m.bound), m.bound)
        u = (z + m.bound) * (mixer.BINS - 1) / (2 * m.bound)
        lo = min(int(u), mixer.BINS - 2)
        bins = [(spot[i] * mixer.BINS + lo, 1 - (u - lo)), (spot[i] * mixer.BINS + lo + 1, u - lo)]
        final = (z + sum(much * logit((m.hit[c] + hit[c]) / (m.all[c] + every[c])) for c, much in bins)) / 2
        if bit is None:
            p, event = sigmoid(final) * math.exp(a[i]) + (1 - sigmoid(final)) * math.exp(b[i]), lambda q: sigmoid(q) * math.exp(a[i]) / (sigmoid(q) * math.exp(a[i]) + (1 - sigmoid(q)) * math.exp(b[i]))
        else:
            p, event = sigmoid(final if bit[i] else -final), lambda q: float(bit[i])
        out.append(math.log(p))
        held.append((near[i], event(z) - sigmoid(z), y, event(final), bins))
        rank += 1
    return out


@pytest.mark.parametrize("name", ["U", "C", "A", "B"])
def test_refined_mixers_equal_a_plain_loop(name, monkeypatch):
    """Mixer and map, learned in training, then going on along each document; whole, and cut within a document."""
    import numpy as np

    rng = np.random.default_rng(5)
    _, gates, cells, spots, _, _ = mixer.MIXERS[name]

    def steps(doc):
        n = len(doc)
        x, gate, spot, near = rng.normal(0, 2, (3, n)), rng.integers(0, gates, n), rng.integers(0, spots, n), rng.integers(0, cells, n)
        what = {"bit": rng.random(n) < 0.3} if name in "UB" else {"a": np.where(rng.random(n) < 0.4, -np.inf, rng.normal(-3, 2, n)), "b": rng.normal(-6, 3, n)}
        return [x, gate, spot, doc], {"near": near if cells != gates else gate, **what}

    sums = []
    for seed in range(3):  # the tasks of a training
        m = mixer.Model(name)
        args, rest = steps(np.zeros(9000, np.int64))
        m.learn(mixer.Steps(*args, **rest), np.arange(9000) % (seed + 2) > 0)
        sums.append(m.sums())
    model = mixer.Model.of(name, sum(sums))
    assert np.array_equal(sum(sums), sum(reversed(sums))) and (model.weights != mixer.Model(name).weights).any() and (model.hit != mixer.Model(name).hit).any()
    monkeypatch.setattr(mixer, "DOCS", 4)
    args, rest = steps(np.repeat(np.arange(12), [1, 40, 300, 2, 0, 1500, 31, 32, 33, 5, 90, 700]))
    got, _ = model.follow(mixer.Steps(*args, **rest))
    x, gate, spot, doc = args
    want = _plain_follow(model, x, gate, rest["near"], spot, doc, rest.get("bit"), rest.get("a"), rest.get("b"))
    assert got == pytest.approx(want, rel=1e-9)


def test_refined_spelling_is_a_distribution():
    """Also what was learned along a document leaves the words of one byte, and the continuations of one, less than 1 together."""
    import numpy as np

    raw = [(np.arange(2 * n) % 7).astype(np.uint32) for n in mixer.CONTEXTS.values()]
    tables, model = [(mixer.logits(t), mixer.gates(t)) for t in raw], mixer.Model("B")
    mixer.learn_spelling([b"abc", b"abd", "\u00e9t\u00e9".encode()] * 50, raw, model)
    model = mixer.Model.of("B", model.sums())
    before = [b"zzz%d" % k for k in range(40)]
    for head in (b"", b"a"):
        p = [mixer.spell([*before, head + bytes([b])], np.zeros(41, np.int64), tables, model)[-1] for b in range(256) if b != 32]
        assert 0 < np.exp(p).sum() < 1
    long = mixer.spell(before, np.zeros(40, np.int64), tables, model)
    assert long[-10:].sum() > mixer.word_scores(before[-10:], tables).sum()  # it has learned what the document looks like


def test_mixer_learns_from_all_training_texts_and_refines(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    both = mixer.score_documents(whole).where("NOT train").agg(F.sum("refined_score").alias("s"), F.sum("score").alias("m")).first()
    out = mixer.op3_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.lit(both["m"]).alias("m")).first()
    assert out["s"] == pytest.approx(both["s"], rel=1e-3)
    assert out["s"] > 0.99 * out["m"]  # logarithms: at least 1 % fewer bits
    rng = random.Random(3)
    prose = [" ".join(rng.choices([f"v{k}" for k in range(300)], k=200)) for _ in range(40)]
    junk = lambda: " ".join("".join(rng.choices("0123456789abcdef", k=12)) for _ in range(60))
    asked = [(100, junk(), False)]

    def scored(texts, parts):
        rows = [(i, t, True) for i, t in enumerate(texts)] + asked
        frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(parts)
        return {r["doc_id"]: r for r in mixer.score_documents(frame).collect()}

    last = [*prose, *[junk() for _ in range(20)]]  # the kind of text asked for comes last, in whatever task
    for parts in (1, 7):
        with_, without = scored(last, parts)[100], scored(prose, parts)[100]
        assert with_["refined_score"] > without["refined_score"]
        assert with_["refined_score"] > with_["score"]


def test_bits_of_known_words_equal_the_plain_mixer(monkeypatch):
    """spell() has all words' bits as Model.follow has them, and learns along each document alike."""
    import numpy as np

    rng = random.Random(4)
    distinct = [b"the", b"of", b"\n", *("".join(rng.choices("abcdefg\u00e9", k=rng.randrange(1, 30))).encode() for _ in range(60))]
    raw = [np.zeros(2 * n, np.int64) for n in mixer.CONTEXTS.values()]
    model = mixer.Model("B")
    times = np.array([rng.choice([1, 1, 5, 70000]) for _ in distinct])
    for _ in range(3):
        mixer.learn_spelling(distinct, raw, model, times)
    bits = mixer.Bits(distinct, mixer.joined([(mixer.logits(t), mixer.gates(t)) for t in raw]))
    assert all(t.sum() == 3 * (bits.n * times).sum() for t in raw)  # each bit as often as its word occurs
    tables, model = [(mixer.logits(t), mixer.gates(t)) for t in raw], mixer.Model.of("B", model.sums())
    size = [1, 700, 3, 0, 40, 12, 200]
    doc, of = np.repeat(np.arange(len(size)), size), np.array([rng.randrange(len(distinct)) for _ in range(sum(size))])
    ends = np.cumsum(bits.n)
    at = np.concatenate([np.arange(ends[w] - bits.n[w], ends[w]) for w in of])
    s = bits.steps()
    steps = mixer.Steps([x[at] for x in s.x[:-1]], s.gate[at], s.spot[at], np.repeat(doc, bits.n[of]), bit=s.bit[at], near=s.near[at])
    want = mixer._word_sums(model.follow(steps)[0], bits.n[of])
    for docs in (128, 2):
        monkeypatch.setattr(mixer, "SPELL_DOCS", docs)
        assert mixer.spell(distinct, doc, tables, model, of) == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_equal_bytes_of_a_block_are_mixed_once(monkeypatch):
    """Bits are held once for equal bytes after equal bytes, and worked on once for each block, with what all of them would have done."""
    import numpy as np

    monkeypatch.setattr(mixer, "SPELL", 1 << 10)
    rng = random.Random(6)
    words = [b"\x00", b"\x00a", b"\n", *("".join(rng.choices(("ba", "na", "\u00e9t"), k=rng.randrange(1, 12))).encode() for _ in range(3000))]
    raw = [(np.arange(2 * n) % 7).astype(np.int64) for n in mixer.CONTEXTS.values()]
    tables = mixer.joined([(mixer.logits(t), mixer.gates(t)) for t in raw])
    b = mixer.Bits(words, tables)
    slots, bit, n = mixer._decisions(np.frombuffer(b" ".join(words) + b" ", np.uint8), b.starts)
    assert (b.n == n).all() and (b.steps().bit == bit).all() and b.long.sum() < n.sum() / 20
    # learning: all bits, in groups of words, by the plain rule
    plain, model, lo, want = mixer.Model("B"), mixer.Model("B"), 0, []
    while lo < len(words):
        hi = lo + 1
        while hi < len(words) and b.size[lo:hi].sum() < mixer.SPELL:
            hi += 1
        one = mixer.Bits(words[lo:hi], tables)
        z = plain.learn(one.steps(), np.ones(one.n.sum()))
        want.append(mixer._word_sums(-np.log1p(np.exp(np.where(one.steps().bit, -z, z))), one.n))
        lo = hi
    times = np.arange(len(words)) % 3 + 1
    assert mixer.learn_spelling(words, raw, model, times) == pytest.approx(np.concatenate(want), rel=1e-3)
    for a in ("weights", "hit", "all", "steps"):
        assert getattr(model, a) == pytest.approx(getattr(plain, a), rel=1e-3, abs=1e-3)
    for t, h in zip(raw, slots):
        counted = np.bincount(((h & np.uint32(len(t) // 2 - 1)) << np.uint32(1)) | bit, np.repeat(times, n), minlength=len(t))
        assert (t - np.arange(len(t)) % 7 == counted).all()
    # a document: every bit belongs to one unit, and few units stand for many
    units = mixer._doc_units(model, b, b.of, np.array([b.n.sum()]))
    assert (units.long * units.times).sum() == b.n.sum() and units.long.sum() < b.n.sum() / 3


def test_no_bit_is_learned_from_that_nothing_comes_after(monkeypatch):
    """The last block of each document is scored only; the next documents' scores stay those of Model.follow's rule."""
    import numpy as np

    words, model, learned, slopes = [b"abc", b"abd", b"b", b"\n"], mixer.Model("B"), [], mixer._slopes
    raw = [(np.arange(2 * n) % 7).astype(np.int64) for n in mixer.CONTEXTS.values()]
    tables = [(mixer.logits(t), mixer.gates(t)) for t in raw]
    n = mixer.Bits(words, mixer.joined(tables)).n
    monkeypatch.setattr(mixer, "_slopes", lambda cell, *rest: learned.append(len(cell)) or slopes(cell, *rest))
    short, long = np.arange(8) % 4, np.arange(200) % 4
    assert n[short].sum() < model.block < n[long].sum() < 2 * model.block + model.block * (mixer.WIDE - 1)
    alone = mixer.spell(words, np.zeros(8, np.int64), tables, model, short)
    assert not learned
    both = mixer.spell(words, np.repeat([0, 1, 2], [8, 200, 8]), tables, model, np.concatenate([short, long, short]))
    assert learned and both[:8] == pytest.approx(alone) and both[-8:] == pytest.approx(alone)
    taught = sum(learned)
    learned.clear()
    mixer.spell(words, np.zeros(200, np.int64), tables, model, long)
    assert sum(learned) == taught  # the short documents taught nothing


def test_tables_follow_their_counts_slot_by_slot(monkeypatch):
    """A piece brings up to date the slots that it counted, not the whole tables; they equal those made from all counts."""
    import numpy as np

    rng, made, logits = random.Random(8), [], mixer.logits
    raw, models = [np.zeros(2 * n, np.int64) for n in mixer.CONTEXTS.values()], [mixer.Model("B"), mixer.Model("B")]
    kept, other = mixer.joined([(mixer.logits(t), mixer.gates(t)) for t in raw]), [t.copy() for t in raw]
    for _ in range(3):
        text = [" ".join("".join(rng.choices("abc\u00e9", k=rng.randrange(1, 6))) for _ in range(50)).encode() for _ in range(4)]
        piece = mixer.Piece([*text, b""])
        at = np.flatnonzero(np.arange(len(piece.keys)) % 5 > 0)
        words, times = piece.words(at), np.arange(len(at)) % 3 + 1
        spelling = piece.spelling(at)
        assert [bytes(x)[:-1] for x in np.split(spelling.text, np.cumsum(spelling.size)[:-1])] == words
        want = mixer.learn_spelling(words, other, models[0], times)
        monkeypatch.setattr(mixer, "logits", lambda counts: made.append(len(counts)) or logits(counts))
        assert (mixer.learn_spelling(spelling, raw, models[1], times, kept) == want).all()
        monkeypatch.setattr(mixer, "logits", logits)
        for a, b, c in zip(raw, other, kept, strict=True):
            assert (a == b).all() and (c == mixer.joined([(logits(a), mixer.gates(a))])[0]).all()
    assert len(made) == 9 and sum(made) < sum(map(len, raw)) / 10
    everything = piece.spelling(np.arange(len(piece.keys)))
    assert [bytes(x)[:-1] for x in np.split(everything.text, np.cumsum(everything.size)[:-1])] == piece.words(np.arange(len(piece.keys)))


def test_spelling_is_learned_from_words_that_repeat(spark):
    """Training texts without a word that occurs once teach how words are spelled; and a known word has its bits beside its share."""
    rng = random.Random(5)
    alike, unlike = ([" ".join(" ".join([w, w]) for w in ("".join(rng.choices(letters, k=8)) for _ in range(60))) for _ in range(10)] for letters in ("01234567", "qxzjkvwy"))
    asked = " ".join("".join(rng.choices("01234567", k=9)) for _ in range(30))

    def score(texts):
        rows = [(i, t, True) for i, t in enumerate(texts)] + [(100, asked, False)]
        out = mixer.score_documents(spark.createDataFrame(rows, "doc_id long, text string, train boolean").coalesce(1), plain=False)
        return out.where("doc_id = 100").first()["refined_score"]

    assert score(alike) > 0.8 * score(unlike)


def test_spelling_is_a_distribution():
    """The words of one byte, and the continuations of one, have probabilities that add up to less than one."""
    import numpy as np

    tables = [(mixer.logits((np.arange(2 * n) % 7).astype(np.uint32)), mixer.gates((np.arange(2 * n) % 7).astype(np.uint32))) for n in mixer.CONTEXTS.values()]
    for head in (b"", b"a"):
        word = mixer.word_scores([head + bytes([b]) for b in range(256) if b != 32], tables)
        assert 0 < np.exp(word).sum() < 1


def test_chat(spark):
    for t in ("</s>[INST] ok [/INST]", "a\\b<|end|>\n<|turn|>x", "", "\\", "<\\s>"):
        assert chat.parse(chat.piece("user", t) + chat.piece(t, "y")) == [("user", t), (t, "y")]
    records = {
        1: ('{"prompt": "p", "completion": "c", "id": 7, "meta": {"text": "x"}}', [("user", "p"), ("assistant", "c")]),
        2: ('{"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": null}, {"content": "z"}]}', [("user", "u"), ("assistant", ""), ("", "z")]),
        3: ('{"system": "s", "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', [("system", "s"), ("user", "h"), ("assistant", "g")]),
        4: ('{"instruction": "i", "input": "more", "output": {"a": 1}}', None),
        5: ('{"instruction": "i", "input": "more", "output": "o", "system": ""}', [("user", "i\nmore"), ("assistant", "o")]),
        6: ('{"data": {"messages": [{"role": "bot", "content": "b"}]}, "messages_count": 1}', [("assistant", "b")]),
        7: ("{", None), 8: (None, None), 9: ('{"odd": 1}', None), 10: ('{"messages": []}', None), 11: ("[]", None), 12: ("3", None),
    }
    frame = spark.createDataFrame([(k, r, "x") for k, (r, _) in records.items()], "conv_id long, record string, text string")
    got = [tuple(r) for r in chat.canonical_turns(frame).select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    assert got == [(k, *t) for k, (_, turns) in records.items() for t in ([(None, None, None)] if turns is None else [(i, *t) for i, t in enumerate(turns)])]
    assert chat.digests(chat.format_turns(chat.canonical_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    long = "word [INST] " * 200_000
    r = chat.digests(chat.format_turns(chat.canonical_rows(spark.createDataFrame([(None, 0, "assistant", long)] * 2, "conv_id long, turn long, role string, text string")))).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, 2 * len(long), hashlib.sha256(2 * long.encode()).hexdigest())
    turns = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, "assistant", "hé", "y")], "conv_id long, turn long, role string, text string, formatted string")
    r = chat.digests(chat.format_turns(chat.canonical_rows(turns))).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, 2, hashlib.sha256("hé".encode()).hexdigest())
    assert r["turns_sha256"] == hashlib.sha256("user\n\nassistant\nhé\n".encode()).hexdigest()


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, "http://a/?%\n", big), (2, None, big), (3, "u", "s"), (4, "u", "s"), (5, "u", None), (None, "n", "q"), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = Scratch(spark).keep(warc.write_archives(pages, fresh(spark, "warc")), "manifest")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in warc.read_archives(manifest).collect())
    assert [g[:4] for g in got] == [(0, "response", None, 1), (1, "revisit", 2, 2000), (2, "response", None, 2000), (2, "revisit", 2, 2000), (3, "response", None, 1), (4, "response", None, 1), (5, "response", None, 0)]
    assert got[1][4] == "http://a/?%\n"
    empty = warc.write_archives(pages.limit(0), fresh(spark, "warc"))
    assert warc.read_archives(Scratch(spark).keep(empty, "manifest")).count() == 0


def test_urls(spark):
    rows = [(1, "https://X.com/a"), (2, "http://b.example.com/en/1"), (3, "https://www.example.com/en/"), (4, "x://net/fr/?q"), (5, None), (6, "nothing"), (7, "http://com"), (8, "http://spam.org/buy/7"), (9, "http://ok.org/buy")]
    pages = spark.createDataFrame(rows + [(k, f"http://spam.org/buy/{k}") for k in range(100, 160)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(100, 160)] + [(k, 1, 0) for k in range(1000, 1100)], "doc_id long, quality int, toxic int")
    pages = pages.unionByName(spark.createDataFrame([(k, f"http://fine.org/read/{k}") for k in range(1000, 1100)], "page_id long, url string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, labels).collect()}
    assert [got[k] for k in range(1, 8)] == [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert got[8] == (None, "block")
    assert urls.judge(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_urls_rules_of_several_tokens_decide(spark):
    """Pages are bad where a host and a path meet; rules and verdicts equal a plain search through all combinations."""
    import itertools

    rng = random.Random(12)
    hosts, paths, names = ["a.site.org", "b.site.org", "shop.other.org", "m.other.org"], ["buy", "read", "list"], ["ref", "page", "id"]
    pages, labels = [], []
    for k in range(1500):
        h, p, q = rng.choice(hosts), rng.choice(paths), rng.choice([*names, None])
        bad = (h.endswith("other.org") and p == "buy") or (h == "a.site.org" and q == "ref" and p == "list")
        pages.append((k, f"http://{h}/{p}/{k}.html" + (f"?{q}=1" if q else "")))
        if k % 3:
            labels.append((k, 0 if bad != (rng.random() < 0.04) else 1, None))
    labels += labels[:5] + [(None, 0, 1), (5000, 0, 1)]
    extra = [(None, None), (9000, "http://m.other.org/buy/"), (9001, "http://m.other.org/buy/"), (9002, "http://m.other.org/read/"), (9003, "ftp://a.site.org/list/?ref"), (9004, "http://a.site.org/list/?page=1")]
    frame = spark.createDataFrame([(i, u, 0) for i, u in pages + extra], "page_id long, url string, doc_id long")

    def tokens(u):
        if not u:
            return frozenset()
        host, _, rest = u.split("://", 1)[1].partition("/")
        path, _, query = rest.partition("?")
        parts = host.split(".")
        out = {"host:" + ".".join(parts[k:]) for k in range(len(parts))}
        out |= {"path:" + re.sub(r"\.\w+$", "", x) for x in ("/" + path).split("/")} | {"query:" + x.split("=")[0] for x in query.split("&")}
        return frozenset(t for t in out if not re.fullmatch("(path|query):[0-9]*", t))

    bad = {}
    for d, q, t in labels:
        bad[d] = bad.get(d, False) or q == 0 or t == 1
    marked = [(tokens(u), bad[i]) for i, u in pages if i in bad]
    n, n_bad = len(marked), sum(b for _, b in marked)
    count = collections.defaultdict(lambda: [0, 0])
    for t, b in marked:
        for k in range(1, 6):
            for x in itertools.combinations(sorted(t), k):
                if sum(y.startswith("host:") for y in x) <= 1:
                    count[frozenset(x)][b] += 1
    least = max(urls.MIN_PAGES, urls.SUPPORT * n_bad)
    sure = {x for x, (good, b) in count.items() if b >= least and b >= urls.CONFIDENCE * (good + b) and b / (good + b) >= urls.LIFT * n_bad / n}
    rules = {x for x in sure if not any(y < x for y in sure)}
    assert any(len(x) > 1 for x in rules)
    want = {i: "block" if any(x <= tokens(u) for x in rules) else "allow" for i, u in pages + extra}
    got = urls.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("url", F.lit("x"))).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == want and len(got) == len(pages) + len(extra) and {r["rule"] for r in got} == {None}
    assert want[9000] == "block" and want[9002] == "allow" and want[9003] == "block" and want[9004] == "allow"


def _pipeline_rows():
    rng = random.Random(5)
    common = "the of and to in that was with have from which their been would".split()
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    make = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n))
    texts = [make(rng.randrange(80, 240)) for _ in range(60)]
    passage = make(70)
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    near = lambda t: " ".join(w if rng.random() > 0.01 else word() for w in t.split())
    rows += [(100 + i, near(texts[i]), "en", "s0", 1) for i in range(12)] + [(5, texts[5], "en", "copy", 1)]
    rows += [(200 + i, f"{make(60)} {passage} {make(30)}", "en", "s1", 1) for i in range(6)]
    rows += [(300 + i, f"{make(50)} {q} {make(40)}", "en", "s2", 1) for i, q in enumerate(["How many apples does the farmer sell at the old market near the river in the morning"] * 2)]
    # of one id, of none, and equal in all columns
    rows += [(7, make(90), "en", "s0", 1), (None, make(90), "en", "s1", 1), (None, make(95), "en", None, 1), (None, texts[2], "en", "s1", 1), rows[3], rows[3]]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, "#$% " * 80, "en", "s0", 320), (403, "same words again " * 40, "en", "s1", 1)]
    return rows


ITEMS = [(1, "How many apples does the farmer sell at the old market near the river in the morning"), (2, None), (3, "Something that no document has at all in any of its many sentences")]


def _documents(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, class long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage's rows against a plain version of it, each over the rows that its predecessor kept."""
    import corpus_pipeline

    path = f"file://{tmp_path}"
    _documents(spark, _pipeline_rows(), path)
    docs, plain = spark.read.parquet(f"{path}/documents.parquet"), [tuple(r)[:5] for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    steps, scratch = dict(corpus_pipeline.STAGES), Scratch(spark)
    run = lambda name: scratch.keep(steps[name](spark, docs, path), "stage")
    same = lambda rows: collections.Counter(tuple(r) for r in rows)

    plain = [r for r, (kept, _) in zip(plain, _plain_verdicts([r[:3] for r in plain])) if kept]
    docs = run("quality rules")
    assert docs.columns == corpus_pipeline.COLUMNS and same(docs.collect()) == same(plain) and len(plain) > 60

    sets = {r: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for r in set(plain) for x in [words(r[1].lower())]}
    kept, groups = [], []
    for r in sorted(sets, key=str):
        linked = [g for g in groups if any(100 * len(sets[r] & sets[x]) >= 80 * len(sets[r] | sets[x]) for x in g)]
        groups = [g for g in groups if g not in linked] + [[r, *(x for g in linked for x in g)]]
    for g in groups:
        ids = [r[0] for r in g if r[0] is not None]
        kept.append([r for r in g if not ids or r[0] == min(ids)])
    docs = run("n-gram Jaccard join")
    got = docs.collect()
    assert len(got) == len(groups) and all(sum(tuple(r) in g for r in got) == 1 for g in kept)
    assert any(len(g) > 1 for g in groups)

    plain = [tuple(r) for r in got]
    cut = _brute_cut([r[:2] for r in plain])
    left = {(i, n): t.decode() for (i, n, gone, t) in cut if gone}
    docs = run("substring dedup")
    want = []
    for r in plain:
        one = _brute_cut([x[:2] for x in plain])
        mine = [t.decode() for (i, n, gone, t) in one if i == r[0] and n == len(words(r[1])) and gone and set(t.decode().split()) <= set(words(r[1]))]
        want.append((r[0], mine[0], *r[2:4], len(mine[0])) if mine else r)
    assert same(docs.collect()) == same(w for w in want if w[1]) and left

    plain = [tuple(r) for r in docs.collect()]
    found = _brute_found([(k, r[1]) for k, r in enumerate(plain)], ITEMS)
    docs = run("benchmark decontamination")
    plain = [r for k, r in enumerate(plain) if k not in {k for k, _ in found}]
    assert same(docs.collect()) == same(plain) and len(found) == 2

    mixed = run("mixing sources to target weights").collect()
    sizes = collections.Counter()
    for r in plain:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    target = dict(zip(order, mixing.water_fill([float(sizes[k]) for k in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))))
    assert same((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in mixed) == same((r[0], r[3], len(words(r[1])), sizes[r[3]]) for r in plain)
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[k] - target[k]) <= max(len(words(r[1])) for r in plain) for k in order)


def test_pipeline_runs_whole_and_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    _documents(spark, _pipeline_rows(), f"file://{tmp_path}/a")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}/a").collect()]
    assert not {100, 101, 300, 301, 400, 401, 402, 403} & set(got) and got.count(7) == 2 and got.count(None) == 2 and got.count(3) == 1
    _documents(spark, _pipeline_rows()[:0], f"file://{tmp_path}/b")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0
    docs = spark.read.parquet(f"file://{tmp_path}/b/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}/b").count() == 0
    bare = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [stage(spark, bare, f"file://{tmp_path}/b").count() for _, stage in corpus_pipeline.STAGES]
    assert kept == [0, 3, 3, 3, 3]


def _odd(spark):
    """Null ids, texts and languages, an empty and a very long text, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(150_000))
    short = "the of and to in that was with " * 12
    rows = [(1, long, "en", "a"), (2, long, None, "a"), (None, short, "en", None), (None, None, None, None), (3, "", "en", "b"), (4, short, "en", "b"), (4, short, "en", "b"), (4, short, "en", "b"), (5, "héé 中文   \x00z", "de", "b"), (6, "x", "de", "a")]
    names = ["row", "sig", "h", "label", "kept", "n", "word", "found", "z", "size", "_row", "_words", "_text", "class", "token", "score", "train_tokens", "piece", "bucket", "kind", "p", "x", "content"]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, frame.select("*", *[F.lit("clash").alias(c) for c in names])


def test_operators_take_odd_rows(spark):
    rows, docs = _odd(spark)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    ids = sorted(({"doc_id": r[0]} for r in rows), key=key)
    runs = {
        1: lambda d: substring.dedup_substrings(d),
        3: lambda d: mixer.score_documents(d.withColumn("train", F.col("doc_id") > 1)),
        5: lambda d: language.predict(d, language.train(d), "doc_id"),
        7: lambda d: mixing.mix(mixing.numbered(mixing.sizes(d))),
        8: lambda d: jaccard.similarity_classes(d),
        10: lambda d: quality.judge(d, ["doc_id"]),
    }
    for n, run in runs.items():
        got = run(docs).collect()
        assert sorted(({"doc_id": r["doc_id"]} for r in got), key=key) == ids, n
        if n not in (7,):
            assert len({str(r) for r in got if r["doc_id"] == 4}) == 1, n  # repeated rows alike
        assert run(docs.limit(0)).count() == 0, n
    items = docs.selectExpr("doc_id AS item_id", "text", "row", "h").where("doc_id = 1")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()} == {(1, 1), (2, 1)}
    cut = {(r["doc_id"], r["n_removed"]) for r in substring.dedup_substrings(docs).collect()}
    assert (2, 150_000) in cut and (1, 0) in cut and (4, 0) in cut
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://a.org/', doc_id) AS url", "text AS html", "row", "token")
    assert urls.judge(pages, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic", "token")).count() == len(rows)
    manifest = Scratch(spark).keep(warc.write_archives(pages, fresh(spark, "warc")), "manifest")
    back = warc.read_archives(manifest).collect()
    payloads = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in back)
    assert payloads == collections.Counter((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for i, t, *_ in rows)
