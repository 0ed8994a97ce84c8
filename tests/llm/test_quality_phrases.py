"""Quality rules, spelling variants and collocations against brute force, and on awkward rows."""

import collections
import random
import re
import zlib
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from hearthlake.llm import collocations, line_quality, spellings

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "word n other form root key part after host ident line lines words n_words kept range run depth phrase suffix a l r score rank salt text_sha256".split()


def corpus():
    """Documents with copies, shared lines, misspelt words, repeated phrases, long texts and rows without a text."""
    rnd = random.Random(5)
    stems = ["property", "apartment", "mortgages", "kitchen", "balconies", "ÉTAGESÀ", "schönes", "bedrooms", "gardening", "transfer"]
    said = ["for sale by owner", "under the hammer", "Close to the sea"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rnd.randint(0, 60)):
            w = rnd.choice(stems)
            if rnd.random() < 0.15:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "x", w[at] * 2]) + w[at + 1 :]
            words.append(w if rnd.random() < 0.8 else rnd.choice(said))
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", ", ", ".\n", "\n", "\x0b", "! "]) for w in words)
        if k % 3 == 0:
            text += "\nAll rights reserved 20%d\n  all RIGHTS reserved\t1999 " % (10 + k % 9)
        rows.append((k, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])))
    rows += [(9000 + k, rows[7][1], "en", "a") for k in range(40)] + [rows[7]] * 2
    rows += [(None, "nobody's property is " * 3, "en", "a"), (500, None, "en", "a"), (501, "", None, None), (502, " \n\t\r ", "en", "b")]
    rows += [(503, "again and again we say it " * 4000, "en", "b"), (504, "y" * 20_000 + " 日本 🙂 \x00 \x1c \xa0 * # <", "ja", "b"), (505, "y" * 19_999 + " " + "y" * 20_000, "ja", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("op", [line_quality.op11, spellings.op12, collocations.op13])
def test_empty(none, op):
    assert op(none).collect() == []


def base_figures(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    at = collections.defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    again = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(5)}
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(again)


def quality(rows, min_docs, share, least_kept):
    alike = lambda x: " ".join(w for w in re.split("[\x20\x09-\x0d]+", re.sub("[0-9]", "0", x.translate(UPPER))) if w)
    texts, of = collections.defaultdict(set), collections.Counter()
    for host, text in {(s, t or "") for _, t, _, s in rows}:
        of[host] += 1
        for line in text.split("\n"):
            if alike(line):
                texts[host, alike(line)].add(text)
    out = []
    for i, text, _, host in rows:
        got = base_figures(text or "")
        failed = got[0] < 10 or 100 * got[4] > 20 * got[0]
        gone = sum(len(alike(x).split(" ")) for x in (text or "").split("\n") if alike(x) and len(texts[host, alike(x)]) > max(min_docs, of[host] * share))
        out.append((i, *got, failed, not failed and got[0] - gone >= least_kept * got[0]))
    return collections.Counter(out)


@pytest.mark.parametrize(("min_docs", "share", "least_kept"), [(10, 0.002, 0.5), (2, 0.02, 0.9), (0, 0.0, 0.01), (1, 0.3, 1.0)])
def test_quality(docs, min_docs, share, least_kept):
    got = line_quality.judge(docs, min_docs, share, least_kept)
    assert got.columns == ["doc_id", *line_quality.FIGURES, "base_failed", "kept"]
    want = quality(corpus(), min_docs, share, least_kept)
    assert collections.Counter(map(tuple, got.collect())) == want
    if (min_docs, share) == (2, 0.02):
        assert any(not k[-2] and not k[-1] for k in want) and any(k[-1] for k in want)


def test_copies_are_no_boilerplate(spark):
    """A document copied a hundred times stays; a line in many different documents goes, as do documents of little else."""
    words = lambda k: " ".join(chr(97 + k % 26) + chr(97 + k // 26) + chr(97 + j) for j in range(20))
    rows = [(k, words(99), "en", "s") for k in range(100)]
    rows += [(200 + k, "read more about our cookies and the terms of use\n" + (words(k) if k >= 5 else "x"), "en", "s") for k in range(40)]
    got = {r["doc_id"]: r for r in line_quality.op11(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k]["kept"] for k in range(100)) and all(got[205 + k]["kept"] for k in range(35))
    assert [(got[200 + k]["base_failed"], got[200 + k]["kept"]) for k in range(5)] == [(False, False)] * 5


def test_many_lines_by_salt(docs):
    texts = line_quality.cut(line_quality.measured(docs))
    remove = line_quality.cut(line_quality.boilerplate(texts, 0, 0.0))
    a, b = (line_quality.depleted(texts, remove, 0.9, few).collect() for few in (10**6, 1))
    assert sorted(a) == sorted(b) and a


@pytest.mark.parametrize("text", ["a " * 5, "a " * 6, "a b c d e f a b c d e", "a b c d e a b c d", "x", "", "a b " * 9 + "c", "p q r s t u v p q r s t q r s t u z"])
def test_repeated(text):
    assert line_quality.figures(text.encode()) == list(base_figures(text))


def spelt(rows):
    """Every pair by deleting one letter of each."""
    counts = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True)) == 1 if len(x) == len(y) else abs(len(x) - len(y)) == 1 and any(max(x, y, key=len)[:k] + max(x, y, key=len)[k + 1 :] == min(x, y, key=len) for k in range(max(len(x), len(y))))
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and apart(v, w)] for w in words}
    form = {w: next((v for v in sorted(near[w], key=lambda v: (-words[v], v))[:1] if words[v] >= 10 * words[w]), None) for w in words}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def test_spellings(docs):
    got = spellings.op12(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = spelt(corpus())
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(w[3] is not None for w in want) > 20 and any(w[2] > 1 for w in want) and any(len(w[0]) > 10_000 for w in want)


@pytest.mark.parametrize("seed", range(4))
def test_near_pairs(spark, seed):
    """Few letters, so that words have many neighbours and edits many places."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)}
    got = spellings.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    pairs = [frozenset((r["word"], r["other"])) for r in got]
    near = lambda v: {v[:k] + c + v[k + e :] for k in range(len(v) + 1) for c in ("", "a", "b") for e in (0, 1)} - {v}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((v, w)) for v in words for w in near(v) & words}


def test_chains(spark):
    """Forms of forms are followed to the last one."""
    rows = [(w, n) for w, n in [("aaaaaaa", 2), ("aaaaaab", 30), ("aaaaabb", 400), ("aaaabbb", 5000), ("aaabbbb", 60000)]]
    forms = spark.createDataFrame([(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)], "word string, form string")
    for steps in (4, 5, 8):
        assert {tuple(r) for r in spellings.roots(forms, steps).collect()} == {(w, "aaabbbb") for w, _ in rows[:-1]}


def phrases(rows, least, top, share):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for g, a in counts.items():
            if len(g) > 1 and a >= least and not any(len(g) == 2 and len(h) == 3 and g in (h[:2], h[1:]) and b >= least and 100 * b >= share * a for h, b in counts.items()):
                s, _, left, right = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), left, right))
        for k, (s, a, g, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, k + 1, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "share", "range_bytes", "shard_bytes", "merge_bytes"), [(10, 2000, 50, 1 << 30, 1 << 30, 1 << 30), (3, 7, 80, 500, 2000, 1), (2, 40, 20, 3000, 1, 20_000)])
def test_collocations(docs, least, top, share, range_bytes, shard_bytes, merge_bytes):
    got = collocations.collocations(docs, least, top, share, range_bytes, shard_bytes, merge_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(corpus(), least, top, share)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_ranges_share_a_word(spark):
    """Bounds within the phrases of one word: each range has the word's own count, and one of them gives it out."""
    raw = b"the cat the dog the eel the cat a dog the cat"
    seen = collocations.tokens(raw)
    numbers = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in seen]
    trie = collocations.built(numbers, collocations.np.array(ids))
    bounds = [("en", b"cat", b"zoo"), ("en", b"the", b"cat"), ("en", b"the", b"dog"), ("en", b"the", b"eat"), ("fr", b"le", b"chat")]
    got = dict(collocations.runs(trie, "en", bounds))
    assert [got[k].one[got[k].words.index(b"the")] for k in (1, 2, 3, 4)] == [5] * 4
    rows = []
    for k, part in got.items():
        part = collocations.Trie.load(part.dump())
        low = bounds[k - 1][1] if k else b""
        rows += [r[:4] for r in collocations.phrases(part, low, 1)]
    assert sum(r[3] for r in rows if r[0] == 0) == len(ids)
    assert sorted(r[1] for r in rows if r[0] == 1) == [b"a", b"cat", b"dog", b"eel", b"the"]
    assert collections.Counter({r[1]: r[3] for r in rows if r[0] == 2}) == collections.Counter(b" ".join(p) for p in zip(seen, seen[1:], strict=False))
    places = [bisect_right([b[1:] for b in bounds[:4]], tuple(r[1].split(b" ")[:2])) for r in rows if r[0] == 3]
    assert places == sorted(places) and len(places) == len(set(zip(seen, seen[1:], seen[2:], strict=False)))


def test_wide_products(spark):
    """Counts whose products pass 64 bits."""
    a, left, right = 3_000_000_000_001, 4_000_000_000_003, 3_000_000_000_007
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).first()["s"]
    assert got == 10**6 * a * a // (left * right)
