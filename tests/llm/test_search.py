"""Fingerprints, neighbours, near duplicates and personal data against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_rows import LONG, TEXTS, documents, no_documents, small  # noqa: F401

from tillroll.llm import fingerprints, jaccard, links, neighbours, privacy
from tillroll.llm.common import bounded_sample
from tillroll.llm.queries import QUERIES

# Fingerprints


def edits(rows):
    """Rows in descending order of id, null last; each text with its edited form."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t, _ in order]
    for (i, *_), t, after in zip(order, texts, texts[1:] + texts[:1]):
        yield i, t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after


@pytest.mark.parametrize("rows", [[r for r in TEXTS if r[0] != 2], TEXTS[:1]], ids=["many", "one"])
def test_edited_texts_and_likeness(spark, rows):
    # Of the rows without an id, which come last, one is kept: their order is by hash.
    rows = [r for r in rows if r[0] is not None or r[1] is not None]
    found = {r.doc_id: r for r in fingerprints.fingerprint_edits(documents(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, text, edited, after in edits(rows):
        r = found[i]
        own, new, other = (fingerprints.digest(x.encode()) for x in (text, edited, after))
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), new.hex())
        assert r.near_edited == fingerprints.likeness(own, new)
        assert r.near_next == fingerprints.likeness(own, other)


def test_fingerprints_of_repeats_and_of_nothing(spark):
    rows = fingerprints.fingerprint_edits(documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in TEXTS)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.n_chars, r.doc_id in (7, 8)].add(r.fingerprint)
    assert len(by_text[1, True]) == 1
    assert fingerprints.fingerprint_edits(no_documents(spark)).collect() == []


def test_one_id_on_a_third_of_the_rows_is_spread(spark):
    """Ranges cut through a hot id and a row repeated often; the results follow the order."""
    draw = random.Random(3)
    made = [(7, " ".join(draw.choices("abcdefg", k=12)), "a") for _ in range(300)]
    made += [(7, "the same row again and again", "a")] * 300
    made += [(i, f"document {i} " + "x" * (i % 9), "b") for i in range(100, 700)]
    table = documents(spark, made, clashes=()).repartition(5)
    placed = fingerprints._with_next(table, "doc_id", "text").filter("not _tail")
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) <= 1.5 * sum(sizes) / len(sizes)
    order = [r._text for r in placed.orderBy(placed._key.desc(), placed._hash.desc()).collect()]
    wanted = Counter()
    for t, after in zip(order, order[1:] + order[:1]):
        m = len(t) // 2
        wanted[hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()] += 1
    found = fingerprints.fingerprint_edits(table).collect()
    assert Counter(r.edited_sha256 for r in found) == wanted


def test_tuples_keep_their_order_as_bytes():
    draw = np.random.default_rng(1)
    ends = np.array([-(2**63), -256, -1, 0, 1, 255, 256, 2**63 - 1])
    rows = [draw.choice(ends, 400) for _ in range(3)]
    packed = fingerprints._ordered(*rows)
    tuples = list(zip(*[r.tolist() for r in rows]))
    assert np.array_equal(np.argsort(packed, kind="stable"), sorted(range(400), key=tuples.__getitem__))


def test_digest_laws():
    draw = random.Random(1)
    texts = [bytes(draw.choices(range(97, 117), k=draw.randint(0, 900))) for _ in range(40)]
    digests = [fingerprints.digest(t) for t in [*texts, b"", b"ab", b"abc", LONG.encode()]]
    assert len({len(d) for d in digests}) == 1
    for a in digests:
        assert fingerprints.likeness(a, a) == 1
        for b in digests:
            assert 0 <= fingerprints.likeness(a, b) <= 1
            assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a)
    codes = fingerprints._UNPACKED[np.frombuffer(digests[-1][1:], np.uint8)].ravel()
    assert max(Counter(codes.tolist()).values()) <= fingerprints.BUCKETS


def test_edits_are_nearer_than_neighbours(spark):
    rows = QUERIES["op5_quartile_fingerprints"](spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) >= 0.99


# Neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, leaf string")


def true_nearest(rows, every, k):
    good = [
        (i, np.array(v, float)) for i, v, _ in rows
        if i is not None and v and None not in v and np.all(np.isfinite(np.array(v, float)))
        and np.any(np.array(v, float) != 0)
    ]
    for i, q in good:
        if i % every == 0:
            scores = sorted((-float(np.float64(q @ x)), j) for j, x in good if j != i)
            yield i, [j for _, j in scores[:k]]


def test_neighbours_of_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(draw.integers(-4, 5, 6))], "") for i in range(1, 90)]
    rows += [(100 + i, [1.0] * 6, "") for i in range(70)]  # ties and copies
    rows += [
        (200, None, ""), (201, [0.0] * 6, ""), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (None, [1.0] * 6, ""),
        (220, [float("nan")] * 6, ""), (240, [float("inf")] * 6, ""), (260, [], ""), (280, [1.0], ""),
    ]
    found = defaultdict(list)
    for r in sorted(neighbours.nearest(vectors(spark, rows)).collect(), key=lambda r: r["rank"]):
        found[r.query_id].append(r.vec_id)
    # So few rows are one leaf, so the search is exact.
    rows = [r for r in rows if r[0] != 280]
    assert found == dict(true_nearest(rows, 20, 20))


@pytest.mark.parametrize(
    "rows", [[], [(20, [1.0, 2.0], "")], [(1, [1.0], ""), (3, [2.0], "")], [(20, None, "")]]
)
def test_neighbours_of_too_few(spark, rows):
    assert neighbours.nearest(vectors(spark, rows)).collect() == []


def test_tree_places_and_visits_every_leaf():
    x = np.random.default_rng(0).normal(size=(3000, 8))
    tree = neighbours.KMeansTree.fit(x, 20)
    assert tree.leaves >= 10
    assert set(tree.assign(x)) == set(range(tree.leaves))
    order = tree.visit(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves))
    assert tree.visit(x[0], 3) == order[:3]
    same = neighbours.KMeansTree.fit(np.ones((500, 4)), 10)
    assert same.leaves == 1


def test_recall_on_the_tables(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = neighbours.nearest(table).collect()
    rows = [(r.vec_id, r.embedding, "") for r in table.collect()]
    truth = {(i, j) for i, own in true_nearest(rows, 20, 20) for j in own}
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(got & truth) >= 0.9 * len(truth) and len(got) == len(truth)


@pytest.mark.parametrize("folder, least", [("sf0.01", 2), ("sf0.1", 8)])
def test_shipped_trees_have_leaves_and_recall(spark, folder, least, monkeypatch):
    """As shipped, on the tables: more than one leaf, and recall on queries not calibrated with."""
    monkeypatch.setattr(neighbours, "CALIBRATION_QUERIES", 64)
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, "") for r in table.collect()]
    sample = np.array([v for _, v, _ in rows], float)
    leaves = neighbours.KMeansTree.fit(sample, neighbours.leaves_for(len(rows), len(rows))).leaves
    assert leaves >= least
    queries = table.filter("vec_id % 4 = 0")
    used = {r.vec_id for r in bounded_sample(queries, "vec_id", 64).collect()}
    truth = {(i, j) for i, own in true_nearest(rows, 4, 20) for j in own if i not in used}
    found = neighbours.nearest(table, every=4).collect()
    got = {(r.query_id, r.vec_id) for r in found if r.query_id not in used}
    assert len(truth) >= 20 * 60
    assert len(got & truth) >= 0.9 * len(truth) and len(got) == len(truth)


def test_leaves_grow_with_the_root_of_the_table():
    sample = neighbours.SAMPLE_ROWS
    asked = [neighbours.leaves_for(n, min(n, sample)) for n in (100, 500, 10**4, 10**6, 10**8)]
    assert asked == [1, 3, 25, 250, 2500]


def test_repeated_query_ids(spark):
    """One id with two vectors asks twice; equal rows ask once; repeats are candidates each."""
    rows = [(20, [1.0, 0.0], ""), (20, [1.0, 0.0], ""), (20, [0.0, 1.0], "")]
    rows += [(1, [2.0, 0.0], ""), (2, [0.0, 3.0], ""), (3, [1.0, 1.0], ""), (3, [1.0, 1.0], "")]
    found = neighbours.nearest(vectors(spark, rows), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (20, 1, 1, 2.0), (20, 1, 2, 3.0), (20, 2, 3, 1.0), (20, 2, 3, 1.0),
    ]


# Near duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def true_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, *_) in enumerate(rows):
        known = [x for x in (least.get(root(a)), i) if x is not None]
        least[root(a)] = min(known, default=None)
    return Counter((i, len(sets[a]), least[root(a)]) for a, (i, *_) in enumerate(rows))


def near_copies():
    """A family of edits of one text, longer than a short list, and texts around it."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(90):
        words = list(base)
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
        if draw.random() < 0.3:
            words += [f"y{i}"]
        rows.append((i, " ".join(words), "a"))
        i += 1
    line = "a line that very many documents share with each other word for word"
    for _ in range(60):
        own = " ".join(f"z{draw.randrange(9999)}" for _ in range(draw.randint(3, 40)))
        rows.append((i, f"{own} {line}", "b"))
        i += 1
    for n in range(1, 9):
        rows += [(i, " ".join(base[:n]), "c"), (i + 1, " ".join(base[:n]).upper(), "c")]
        i += 2
    draw.shuffle(rows)
    return [(1000 - k, t, s) for k, (_, t, s) in enumerate(rows)]


@pytest.mark.parametrize("case", ["edge rows", "family", "family in small blocks"])
def test_components(spark, monkeypatch, case):
    if case == "family in small blocks":
        monkeypatch.setattr(jaccard, "SHORT_LIST", 4)
        monkeypatch.setattr(links, "BLOCK", 16)
        monkeypatch.setattr(links, "BROADCAST_KEYS", 0)
    rows = TEXTS if case == "edge rows" else near_copies()
    found = jaccard.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == true_components(rows)


def test_one_document_of_each_component_stays(spark):
    docs = documents(spark)
    kept = jaccard.distinct_documents(docs)
    assert kept.schema.names == docs.schema.names
    ids = Counter(r.doc_id for r in kept.collect())
    # 1 stands for 2 and 7 for 8; texts without words stay.
    assert ids == Counter([1, 3, 4, 5, 6, 7, 9, 10, -5, None, None])
    assert jaccard.distinct_documents(no_documents(spark)).collect() == []


def test_unrelated_texts_under_one_id_all_stay(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    near = y.replace("y59", "z")
    texts = [(5, x, "a"), (5, y, "a"), (9, near, "a"), (5, x, "a"), (7, x, "b")]
    kept = jaccard.distinct_documents(documents(spark, texts)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(5, x), (5, y)])


def test_filters_never_reject_a_link():
    draw = np.random.default_rng(5)
    for _ in range(300):
        size = int(draw.integers(1, 400))
        a = np.unique(draw.integers(-(2**62), 2**62, size))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < draw.uniform(0.7, 1)],
                                      draw.integers(-(2**62), 2**62, int(draw.integers(0, 40)))]))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        assert linked == (both >= links.least_common(len(a) + len(b)))
        if linked and len(b):
            pa_, pb = a[: jaccard.prefix_length(len(a))], b[: jaccard.prefix_length(len(b))]
            assert len(np.intersect1d(pa_, pb))
            assert links.can_be_linked(len(a), links.sketch(a), len(b), links.sketch(b))
            order = np.argsort([len(a), len(b)], kind="stable")
            pair = [(a, b)[k] for k in order]
            made = links.Sketches(np.array([len(x) for x in pair]), [links.sketch(x) for x in pair])
            assert list(made.near(0, made.larger(0))) == [1]


def test_work_grows_with_the_family(spark, monkeypatch):
    asked = []
    whole = links.Verifier.__call__

    def counted(self, pairs, label):
        asked.append(pairs.count())
        return whole(self, pairs, label)

    monkeypatch.setattr(links.Verifier, "__call__", counted)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    for n in (100, 400):
        rows = []
        for i in range(n):
            words = list(base)
            for _ in range(draw.randint(0, 5)):
                words[draw.randrange(120)] = f"x{draw.randrange(n)}"
            rows.append((i, " ".join(words), "a"))
        asked.clear()
        jaccard.near_duplicates(documents(spark, rows))
        assert sum(asked) <= 1.5 * n


# Personal data

PII = [
    (301, "mail a@b.co, then _a@b.co_d@e.fg and x@y", "a"),
    (302, "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 01.002.255.256 0001.1.1.1", "a"),
    (303, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111111111", "a"),
    (304, "phone +1 (234) 555-7890, +123, +1..2, ++49 30 1234567 +12345678901234567", "a"),
    (305, "ünïcode 😀 a@b.co 😀 10.0.0.1\n+1 (234) 555-7890", None),
    (306, "a" * 50_000 + "@" + "b." * 20_000 + "c", "a"),
    (307, "1" * 50_000 + " " + "1 " * 20_000 + "." * 9, "a"),
    (308, "+" + "1-" * 30_000, "a"),
    *TEXTS,
]


def luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(turned)) % 10 == 0


def true_spans(text):
    tests = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(re.sub(r"[^0-9]", "", v)) <= 19 and luhn(re.sub(r"[^0-9]", "", v)),
        "phone": lambda v: 8 <= len(re.sub(r"[^0-9]", "", v)) <= 15,
    }
    for kind, pattern in privacy.PATTERNS.items():
        # The first pattern is slow on runs of letters without a match: skip those.
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(pattern, text):
            if tests[kind](m[0]):
                yield f"{kind}:{m.start()}:{m.end()}"


def test_base_spans(spark):
    rows = [r for r in PII if len(r[1] or "") < 10_000]
    found = privacy.span_report(privacy.personal_data(documents(spark, PII))).collect()
    assert len(found) == len(PII)
    expected = Counter((i, ",".join(true_spans(t or ""))) for i, t, _ in rows)
    short = {i for i, *_ in rows}
    assert Counter((r.doc_id, r.spans) for r in found if r.doc_id in short) == expected
    for r in found:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert r.n_email == len(re.findall("email:", r.spans))
    (long_mail,) = [r for r in found if r.doc_id == 306]
    assert long_mail.spans == f"email:0:{50_001 + 40_001}"
    assert privacy.personal_data(no_documents(spark)).collect() == []


def told_texts():
    """One address met with a code name in different texts, among common words."""
    rows = [(i, f"note {i} the report by Falcon 7731 to x@y.org about item{i}", "a") for i in range(6)]
    rows += [(100 + i, f"the report about item{i} and note to all by hand {i}", "a") for i in range(60)]
    return rows


def test_disclosing_terms_are_those_the_measure_says(spark):
    rows = told_texts()
    docs = documents(spark, rows)
    found = privacy.find_personal_data(docs)
    told = {r.term: r.told for r in privacy.disclosing_terms(docs, found).collect()}
    assert set(told) == {"falcon", "7731"}
    assert all(t == pytest.approx(1.0) for t in told.values())
    lower = {
        r.term: r.told
        for r in privacy.disclosing_terms(docs, found, least_together=1, disclosure=-9.0).collect()
    }
    n, holders = len(rows), 6
    seen = Counter(w for _, t, _ in rows for w in set(re.findall(r"[^\W_]+", t.lower())) if len(w) > 2)
    for term in ("report", "note", "falcon", "about"):
        expected = np.log(6 * n / (seen[term] * holders)) / np.log(n / holders)
        assert lower[term] == pytest.approx(expected)
    copies = documents(spark, [(i, rows[0][1], "a") for i in range(6)] + rows[6:])
    assert privacy.disclosing_terms(copies, privacy.find_personal_data(copies)).count() == 0


def test_values_are_told_apart_by_what_they_name(spark):
    spelt = [
        ("Falcon", "4111 1111 1111 1111"), ("Falcon", "4111-1111-1111-1111"),
        ("Heron", "+1 (234) 555-7890"), ("Heron", "+1 234 555 7890"),
        ("Osprey", "10.0.0.7"), ("Osprey", "010.000.0.07"),
        ("Kestrel", "Who@Ex.org"), ("Kestrel", "who@ex.ORG"),
    ]
    rows = [(i, f"case {i} of {name}: {value} item{i}", "a") for i, (name, value) in enumerate(spelt)]
    rows += [(100 + i, f"case {i} of none, item{i}", "a") for i in range(80)]
    docs = documents(spark, rows)
    told = privacy.disclosing_terms(docs, privacy.find_personal_data(docs)).collect()
    assert {(r.kind, r.term) for r in told} == {
        ("card", "falcon"), ("phone", "heron"), ("ip", "osprey"), ("email", "kestrel")
    }


@pytest.mark.parametrize("copies", [2, 12])
def test_near_copies_tell_nothing_more(spark, copies):
    rare = [f"rare{i}" for i in range(100)]
    rows = []
    for i in range(copies):
        words = rare[:i] + [f"own{i}"] + rare[i + 1 :]
        rows.append((i, " ".join([*words, "mail who@ex.org"]), "a"))
    rows += [(100 + i, f"mail of day {i} to all, item{i}", "a") for i in range(60)]
    docs = documents(spark, rows)
    assert privacy.disclosing_terms(docs, privacy.find_personal_data(docs)).count() == 0
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[0] == rows[0][1].replace("who@ex.org", "<EMAIL>")
    # A name that stands in unlike texts as well still tells.
    rows = [(i, f"Falcon {t}", s) if i < 50 else (i, t, s) for i, t, s in rows]
    rows += [(200 + i, f"Falcon mail{i} of who@ex.org to{i}", "a") for i in range(copies)]
    docs = documents(spark, rows)
    told = privacy.disclosing_terms(docs, privacy.find_personal_data(docs)).collect()
    assert {r.term for r in told} == {"falcon"}


def told_by_hand(rows, least_together, disclosure):
    """(kind, value, term) that reach the measure, from all pairs of all texts."""
    words = {}
    for _, text, _ in rows:
        words[text] = {w for w in re.findall(r"[^\W_]+", re.sub(r"\S+@\S+", " ", text).lower())}
    copies, n = Counter(t for _, t, _ in rows), len(rows)
    values = defaultdict(set)
    for text in copies:
        for v in re.findall(r"\S+@\S+", text):
            values[v.lower()].add(text)
    for value, texts in values.items():
        holders = sum(copies[t] for t in texts)
        for term in set().union(*(words[t] for t in texts)):
            both = [t for t in texts if term in words[t]]
            seen = sum(copies[t] for t in copies if term in words[t])
            together = sum(copies[t] for t in both)
            told = np.log(together * n / (seen * holders)) / max(np.log(n / holders), 1e-9)
            if len(term) > 1 and len(both) >= least_together and told >= disclosure:
                yield value, term


def test_bounds_drop_no_term_that_reaches_the_measure(spark):
    draw = random.Random(11)
    rows = []
    for i in range(150):
        words = [f"t{min(draw.randrange(60), draw.randrange(60))}" for _ in range(12)]
        words += [f"v{draw.randrange(9)}@x.org" for _ in range(draw.choice([0, 0, 1, 2]))]
        rows.append((i, " ".join(words), "a"))
    rows += rows[:20]
    docs = documents(spark, rows)
    found = privacy.find_personal_data(docs)
    for least, share in ((2, 0.8), (2, 0.4), (3, 0.5), (1, 0.0)):
        told = privacy.disclosing_terms(docs, found, least, share).collect()
        assert {(r.value, r.term) for r in told} == set(told_by_hand(rows, least, share))


def test_sanitised_text(spark):
    docs = documents(spark, told_texts()[:6] + told_texts()[6:] + [(999, None, "a")])
    clean = privacy.sanitise(docs)
    assert clean.schema.names == docs.schema.names
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] == "note 0 the report by <NAME> <NUMBER> to <EMAIL> about item0"
    assert texts[100] == dict((i, t) for i, t, _ in told_texts())[100]
    assert texts[999] is None and len(texts) == 67
    assert privacy.sanitise(no_documents(spark)).collect() == []


def test_distant_and_short_terms_are_marked_in_every_document(spark):
    far = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"Dear Bo, case {i} {far} Bo, x@y.org", "a") for i in range(6)]
    rows += [(100 + i, f"case {i} {far} to all", "a") for i in range(60)]
    rows += [(200, "Bo was here", "a")]
    found = privacy.span_report(privacy.personal_data(documents(spark, rows))).collect()
    spans = {r.doc_id: r.spans for r in found}
    text = rows[0][1]
    last = text.rindex("Bo")
    assert "term:0:4" in spans[0] and "term:5:7" in spans[0]
    assert f"term:{last}:{last + 2}" in spans[0]
    assert spans[200] == "term:0:2" and spans[100] == ""


def test_personal_data_runs_without_python(spark, small):
    plan = QUERIES["op9_disclosure_pii"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
