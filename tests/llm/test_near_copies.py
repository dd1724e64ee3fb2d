"""Jaccard components and fuzzy lines against brute force."""

import random
import re
from itertools import combinations

import pytest

from odd_tables import SF0001, none, odd  # noqa: F401
from duelframe.llm import line_dedup as LD
from duelframe.llm.components import components
from duelframe.llm.ngram_join import jaccard_components, keep_one

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, k):
    w = WORD.findall((text or "").encode().translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    linked = [(a, b) for a, b in combinations(range(len(rows)), 2)
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = groups(len(rows), linked)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[comp[i]] = min(least.get(comp[i], key), key)
    return sorted(((rows[i][0], len(sets[i]), least.get(comp[i])) for i in range(len(rows))), key=repr)


def check(df, k, percent):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k, percent).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], k, percent)


def test_components_against_brute_force(spark):
    """Chains of drifting copies, exact copies, shared passages and very short texts."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(6):
        now = [word() for _ in range(r.randint(20, 120))]
        for _ in range(9):
            texts.append(" ".join(now))
            now = list(now)
            now[r.randrange(len(now))] = word()
            if r.random() < 0.3:
                now.append(word())
    texts += [" ".join([word() for _ in range(5)] + passage + [word() for _ in range(r.randint(0, 9))]) for _ in range(12)]
    texts += ["one", "ONE", "one two", "a b c d", "a  b\tc D", "", None] * 2
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check(df, 4, 85)


def test_driver_documents_against_brute_force(spark):
    check(spark.read.parquet(f"{SF0001}/documents.parquet"), 5, 80)


def test_odd_rows_and_one_of_each_group(odd, none):
    check(odd, 5, 80)
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    all_rows = [(r.doc_id, r.text) for r in odd.collect()]
    gone = {(31, all_rows and next(t for k, t in all_rows if k == 31)), (32, next(t for k, t in all_rows if k == 32))}
    assert rows == sorted({x for x in all_rows} - gone, key=repr)
    assert jaccard_components(none).count() == 0 and keep_one(none).count() == 0


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [
        (r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)] + [(5, 5), (2, 1)]
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    exp = groups(1301, edges)
    assert got == {n: exp[n] for e in edges if e[0] != e[1] for n in e}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, least, similarity):
    import numpy as np
    import pyarrow as pa
    from duelframe.llm.words import WHITE, text_bytes, word_hashes

    def size(line):
        return len(line.replace(" ", "").encode())
    lines = [(k is None, k or 0, i, j, LD.normalise(s)) for i, (k, t) in enumerate(rows)
             for j, s in enumerate((t or "").split("\n")) if size(LD.normalise(s)) >= least]
    sims = LD._simhash(*word_hashes(*text_bytes(pa.array([x[4] for x in lines])), WHITE, None))
    linked = []
    for a, b in combinations(range(len(lines)), 2):
        x, y = lines[a][4], lines[b][4]
        apart = sum(int(v).bit_count() for v in np.bitwise_xor(sims[a], sims[b]))
        if x == y or (apart < len(LD.BLOCKS) and levenshtein(x, y) <= int(max(len(x), len(y)) * (1 - similarity) + 1e-9)):
            linked.append((a, b))
    return lines, groups(len(lines), linked)


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    pool = [" ".join(word() for _ in range(r.randint(4, 60))) for _ in range(25)]
    texts = []
    for _ in range(30):
        own = [" ".join(word() for _ in range(20)) for _ in range(2)]
        for line in r.sample(pool, 3):
            w = line.split(" ")
            if r.random() < 0.5:
                i = r.randrange(len(w))
                w[i] = w[i][:-1] + r.choice("abcdefghij")  # a letter changed
            own.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w) + r.choice(["", " !", " 7", " 8"]))
        r.shuffle(own)
        texts.append("\n".join(own + ["", "short", "short"]))
    rows = list(enumerate(texts))
    lines, comp = brute_lines(rows, 20, 0.8)
    first = {}
    for i in sorted(range(len(lines)), key=lambda i: (lines[i][1], lines[i][3])):
        first.setdefault(comp[i], i)
    drop = {(lines[i][2], lines[i][3]) for i in range(len(lines)) if first[comp[i]] != i}
    exp = {k: "\n".join(s for j, s in enumerate(t.split("\n")) if (i, j) not in drop) for i, (k, t) in enumerate(rows)}
    got = LD.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.kept_text for x in got} == exp
    exact = len(lines) - len({x[4] for x in lines})
    assert sum(x.n_dropped for x in got) == len(drop) > exact > 0  # fuzzy ones among them


def test_lines_of_odd_rows(odd, none):
    got = LD.dedup_lines(odd).collect()
    assert len(got) == odd.count()
    kept = {(x.doc_id, x.kept_text) for x in got}
    assert (40, None) in kept and (41, "") in kept and (43, "two words") in kept
    base = [x for x in got if x.doc_id == 30]
    assert len(base) == 2 and {x.n_dropped for x in base} == {0}  # alike rows keep alike
    assert all(x.n_dropped == x.n_lines for x in got if x.doc_id == 31)
    assert LD.dedup_lines(none).count() == 0


def test_cutting_into_lines():
    import numpy as np
    import pyarrow as pa
    texts = ["a b\nC", None, "", "\n", "x\n", "\n\ny 12-z\n", "é\n", "end"]
    owner, number, size, words, counts = LD._cut(pa.array(texts))
    lines = [(i, j, s) for i, t in enumerate(texts) for j, s in enumerate((t or "").split("\n"))]
    assert list(zip(owner, number)) == [x[:2] for x in lines]
    assert size.tolist() == [len(LD.normalise(s).replace(" ", "").encode()) for *_, s in lines]
    assert counts.tolist() == [len(LD.normalise(s).split()) for *_, s in lines]
    nodes = dict(zip([LD.normalise(s) for *_, s in lines], LD._nodes(words, counts).tolist()))
    assert len(set(nodes.values())) == len(nodes) and nodes["a b"] == LD._nodes(*LD._cut(pa.array(["A-B"]))[3:])[0]
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 25)}" for i in range(1000))
    _, _, _, words, counts = LD._cut(pa.array([many, "p q"]))
    from duelframe.llm.words import COEFFICIENTS, mix
    pairs = words[:999] * COEFFICIENTS[5] + words[1:1000]
    bits = np.unpackbits(mix(np.concatenate([words[:1000], pairs]) + COEFFICIENTS[6]).view(np.uint8).reshape(-1, 8), axis=1)
    assert np.packbits(2 * bits.sum(axis=0, dtype=int) > 1999).view(np.uint64)[0] == LD._simhash(words, counts)[0, 0]


def test_block_tokens_cover_all_bits(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(-1, -1), (0, 0), (5, -9)], "s0 long, s1 long")
    for r in df.select("s0", "s1", LD._blocks().alias("t")).collect():
        whole = (r.s0 & (2 ** 64 - 1)) | ((r.s1 & (2 ** 64 - 1)) << 64)
        at = 0
        for i, (width, token) in enumerate(zip(LD.BLOCKS, r.t)):
            assert token == ((whole >> at) & ((1 << width) - 1)) << 3 | i
            at += width
    assert at == 128 and F is not None


@pytest.mark.parametrize("text", ["", "a", "Ab  C\n", "é" * 3])
def test_normalise_is_stable(text):
    assert LD.normalise(LD.normalise(text)) == LD.normalise(text)


def all_pairs_kept(rows, least, similarity):
    """Texts without repeats, from the edit similarity of all pairs of lines alone."""
    lines = [(i, j, LD.normalise(s)) for i, (_, t) in enumerate(rows) for j, s in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2].replace(" ", "").encode()) >= least]
    linked = [(a, b) for a, b in combinations(range(len(lines)), 2)
              if levenshtein(lines[a][2], lines[b][2]) <= int(max(len(lines[a][2]), len(lines[b][2])) * (1 - similarity) + 1e-9)]
    comp = groups(len(lines), linked)  # the lowest line of the group
    drop = {lines[i][:2] for i in range(len(lines)) if comp[i] != i}
    return [(k, "\n".join(s for j, s in enumerate(t.split("\n")) if (i, j) not in drop)) for i, (k, t) in enumerate(rows)]


def test_lines_against_all_pairs_by_edit_similarity(spark):
    """One replaced word moves more SimHash bits than there are blocks, in lines of any length."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(3, 9)))
    rows = []
    for _ in range(30):
        words = [word() for _ in range(r.randint(8, 40))]
        text = []
        for edits in (0, 1, len(words) // 8, len(words) // 3):
            now = list(words)
            for i in r.sample(range(len(words)), edits):
                now[i] = word()
            text.append(" ".join(now).capitalize() + r.choice([".", " !", ""]))
        r.shuffle(text)
        rows += [(len(rows), text[0] + "\n\n" + text[1]), (len(rows) + 1, text[2] + "\n" + text[3])]
    exp = all_pairs_kept(rows, 20, 0.8)
    got = LD.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), candidates="grams").collect()
    assert sorted((x.doc_id, x.kept_text) for x in got) == exp
    assert sum(x.n_dropped for x in got) > 40


def test_normalised_bytes_and_sampled_runs():
    import pyarrow as pa
    from duelframe.llm.words import text_bytes
    texts = ["", "a b\nC", None, "\n", " x--y \n", "\n\nz é12-z\n", "é\n" + "ab" * 40 + "\n" + "The quick, brown fox jumps"]
    data, offsets = text_bytes(pa.array(texts))
    raw, edges = LD._normal(data, LD._edges(data, offsets))
    lines = [LD.normalise(s) for t in texts for s in (t or "").split("\n")]
    assert [raw[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])] == lines
    line, _, place, chars = LD._sampled(raw, edges, 0.8)
    assert all(chars[i] == len(lines[n]) for i, n in enumerate(line))
    last, again = len(lines) - 1, len(lines) - 2
    assert sorted(place[line == last]) == list(range(len(lines[last]) - 11))  # a short line gives all its runs
    assert set(place[line == again]) <= {-1}  # repeated runs, each once


def test_short_lines_repeat_too(spark):
    rows = [(0, "All rights reserved.\nok\n\n--\nall rights  reserved"), (1, "OK!\n\n--\nAll rights deserved.\nko")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.kept_text for x in LD.dedup_lines(df, candidates="grams", exact=1).collect()}
    assert got == {0: "All rights reserved.\nok\n\n--", 1: "\n--\nAll rights deserved.\nko"}  # alike is not equal
    assert sum(x.n_dropped for x in LD.dedup_lines(df, exact=1).collect()) == 2


def test_rows_of_other_numbers_stay(spark):
    rows = [(0, "2021-03-04 1234567890 55.20 77\nTotal 12"), (1, "1987-12-25 9081726354 31.48 96\nTotal 57"),
            (2, "2021-03-04 1234567890 55.20 78\ntotal: 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.kept_text for x in LD.dedup_lines(df, candidates="grams", exact=1, digits=True).collect()}
    assert got == {0: rows[0][1], 1: rows[1][1], 2: ""}  # one digit of 27 characters is alike
    assert sum(x.n_dropped for x in LD.dedup_lines(df, candidates="simhash", digits=True).collect()) == 1


def test_last_round_forms_no_pairs_inside_a_component(spark):
    """A large component that shares its token with few others."""
    from pyspark.sql import functions as F
    from duelframe.llm.linking import _meetings
    r = random.Random(4)
    rows = [(1, i, 0) for i in range(400)] + [(1, 900, 900)] + [(2, i, 5) for i in range(50)] + [
        (3, i, r.choice([3, 70, 800, 801, 9000])) for i in range(60)] + [(4, i, i) for i in range(13)]
    df = spark.createDataFrame(rows, "token long, node long, comp long").select("token", F.struct("node", "comp", "token").alias("x"))
    got = [(x.x.token, *sorted((x.x.node, x.y.node))) for x in _meetings(df).collect()]
    exp = [(a[0], *sorted((a[1], b[1]))) for a, b in combinations(rows, 2) if a[0] == b[0] and a[2] != b[2]]
    assert sorted(got) == sorted(exp) and sum(x[0] == 1 for x in got) == 400


def test_pairs_of_a_large_group_grow_with_its_items(spark):
    """Items far from the middle of a group are linked to the few in its middle alone."""
    from duelframe.llm.linking import linked_components
    from duelframe.llm.tables import saved
    verified = []

    def verify(pairs):
        verified.extend((x.a, x.b) for x in pairs.collect())
        return saved(pairs.where("least(a % 50, b % 50) = 0 or greatest(a % 50, b % 50) <= 30"), "links")[0]
    n = 1500  # remainder 0: linked to all; up to 30: to each other; above: to those of remainder 0 alone
    nodes = spark.range(n).selectExpr("id as node", "1 as size", "explode(array(1L, 2L)) as token").repartition(4)
    comps = linked_components(nodes.union(nodes), "x.size = y.size", verify).collect()
    assert sorted(x.node for x in comps) == list(range(n)) and {x.comp for x in comps} == {0}
    assert len(verified) == len(set(verified)) < 30 * n
    apart = nodes.where("node % 50 > 30")  # none is linked: every pair is looked at
    verified.clear()
    assert linked_components(apart, "x.size = y.size", verify).isEmpty()
    m = n // 50 * 19
    assert len(set(verified)) == m * (m - 1) // 2 == len(verified)
