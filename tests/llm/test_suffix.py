import hashlib
import random

import numpy as np

from lodestar.llm import suffix


def brute_rows(rows, span):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] of each row, by a dictionary of all strings; rows without an id stand apart."""
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1 if i is not None else 0):
            s = b[p : p + span]
            low[s] = min(low.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1 if i is not None else 0):
            if low[b[p : p + span]] < i:
                gone[p : p + span] = True
        gone = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute(rows, span):
    """doc_id -> the rest of brute_rows()."""
    return {r[0]: r[1:] for r in brute_rows(rows, span)}


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "ñandú", "ing", "東京", "a", "tion", "x", "0"]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passages = [some(40) for _ in range(4)] + ["ab" * 60, "z" * 130]
    rows = []
    for _ in range(60):
        t = "".join(rng.choice([some(rng.randint(1, 25)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :]]) + rng.choice(["", " ", "\0"]) for _ in range(rng.randint(0, 6)))
        rows.append(t)
    rows += [rows[5], rows[5], rows[7], None, "", "short", passages[0][:50], passages[0][:49]]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefghij"):
        s = "".join(rng.choice(alphabet) for _ in range(400)).encode()
        grams, at, first, last = suffix.anchors(s, 50)
        assert first[0] == 0 and last[-1] == len(s) - 50 and (first[1:] == last[:-1] + 1).all()
        for g, a, f, e in zip(grams, at, first, last, strict=True):
            for p in (f, e):
                one = suffix.anchors(s[p : p + 50], 50)
                assert len(one[0]) == 1 and one[0][0] == g and one[1][0] == a - p


def test_merge_equals_sorting_all_suffixes():
    rng = random.Random(1)
    for _ in range(20):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(rng.randint(1, 20))]
        owners = np.array([rng.randint(0, 9) for _ in strings])
        string, low = suffix.smallest_owner(strings, owners, 6, shards=4)
        for k, s in enumerate(strings):
            want = [min(o for t, o in zip(strings, owners, strict=True) if s[p : p + 6] in t) for p in range(len(s) - 5)]
            assert low[string == k].tolist() == want


def test_removal_equals_brute_force(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1.5, None) for i, t in rows], "doc_id long, text string, g double, row string").repartition(5)
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix.repeats(docs).collect()}
        assert got == brute(rows, 50)


def test_the_whole_table_equals_brute_force(spark):
    from lodestar.llm.queries import op1_suffix_array_dedup

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in op1_suffix_array_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows, 50)


def test_a_passage_in_every_document(spark, monkeypatch):
    """Many groups and buckets; the passage stands between bytes of each document's own, or alone, twice, or cut off."""
    monkeypatch.setattr(suffix, "GROUP_BYTES", 2000)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(180))
    rows = []
    for i in range(300):
        own = ["".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 30))) for _ in range(3)]
        part = rng.choice([passage, passage, passage[: rng.randint(40, 180)], passage[rng.randint(0, 130) :], passage + passage, ""])
        rows.append((1000 - i * 3, own[0] + part + own[1] + (passage[20:90] if i % 5 == 0 else "") + own[2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.repeats(docs).collect()} == brute(rows, 50)


def test_kept_texts_and_defined_cases(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(3, "the cat sat " * 900), (3, "the cat sat " * 900), (None, "the cat sat " * 900)]  # repeated rows, and one without an id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix.repeats(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_rows(rows, 50), key=str)
    lost = {(r["doc_id"], r["n_removed"]) for r in found if r["n_removed"]}
    assert lost == {(7, 10800), (10, 10800)}  # by 3, the smallest that has it
    kept = suffix.repeats(odd, keep_text=True)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    want = sorted((str(r) for r in odd.collect() if r["doc_id"] != 10))
    assert sorted(str(r) for r in kept.collect() if r["doc_id"] != 10) == want
    assert [r["text"] for r in kept.collect() if r["doc_id"] == 10] == [""]
    assert suffix.repeats(odd.limit(0)).count() == 0 and suffix.repeats(odd.limit(0), keep_text=True).count() == 0


def test_an_anchor_of_many_contexts_is_split(monkeypatch):
    """Every merge stays small, however many contexts one anchor has; ids and shared parts on both sides of it at random."""
    rng, span = random.Random(5), 20
    k = span // 2 - 1
    held, merges, inner = {}, [], suffix.smallest_owner
    middle = next(t for t in ("".join(rng.choice("pqrs") for _ in range(k)) for _ in range(999)) if suffix.anchors(("a" * (span - k) + t).encode(), span)[1][0] == span - k)
    gram = suffix._mix(suffix._sums([middle.encode()], k)[:, k])[0]
    for _ in range(3000):
        text = ("".join(rng.choice("ab") for _ in range(span - k)) + middle + "".join(rng.choice("ab") for _ in range(span - k))).encode()
        found = [text[f : e + span] for g, f, e in zip(*(suffix.anchors(text, span)[i] for i in (0, 2, 3)), strict=True) if g == gram]
        for context in found:
            held[context] = min(held.get(context, 10**6), rng.randrange(10**6))
    strings, owner = list(held), np.array(list(held.values()))
    assert len(strings) > 1000
    monkeypatch.setattr(suffix, "smallest_owner", lambda s, *rest: merges.append(sum(len(x) + 1 for x in s)) or inner(s, *rest))
    runs = suffix.owned_runs(np.full(len(strings), gram, np.uint64), strings, owner, span, rows=1000)
    assert merges and max(merges) <= 2000
    low = {}
    for s, o in zip(strings, owner.tolist(), strict=True):
        for p in range(len(s) - span + 1):
            low[s[p : p + span]] = min(o, low.get(s[p : p + span], o))
    got = [{} for _ in strings]
    for context, first, last, who in zip(*(x.tolist() for x in runs), strict=True):
        got[context] |= dict.fromkeys(range(first, last + 1), who)
    assert got == [{p: low[s[p : p + span]] for p in range(len(s) - span + 1)} for s in strings]


def test_only_what_contexts_share_is_merged(monkeypatch):
    """Two versions of a passage that differ on the anchor's right: their common starts are one string, and the rest is not merged."""
    rng, merged, inner = random.Random(8), [], suffix.smallest_owner
    text = "".join(rng.choice("abcdefghij") for _ in range(400)).encode()
    grams, _, first, last = suffix.anchors(text, 50)
    i = next(i for i in range(3, len(grams)) if last[i] - first[i] > 5)
    one = text[first[i] : last[i] + 50]
    other = one[:-3] + b"XYZ"
    monkeypatch.setattr(suffix, "smallest_owner", lambda s, *rest: merged.extend(s) or inner(s, *rest))
    runs = suffix.owned_runs(np.full(2, grams[i]), [one, other], np.array([7, 4]), 50)
    n = len(one) - 50
    assert merged == [one[:-3]]
    assert list(zip(*(x.tolist() for x in runs), strict=True)) == [(0, 0, n - 3, 4), (0, n - 2, n, 7), (1, 0, n, 4)]
