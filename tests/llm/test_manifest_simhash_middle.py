"""Merkle manifest, SimHash and fill-in-middle: brute force, round trips and awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparquarry.llm import fill_in_middle as middle
from sparquarry.llm import merkle, simhash
from sparquarry.llm.common import ascii_lower, stored

from test_corpus_operators import AWKWARD, LONG, documents


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fan=16):
    """(root, proof of each leaf): plain lists, level by level."""
    at, proofs = list(leaves), [[] for _ in leaves]
    place = list(range(len(leaves)))
    while len(at) > 1:
        for i, p in enumerate(place):
            run = at[p // fan * fan : p // fan * fan + fan]
            proofs[i] += ["".join(run[: p % fan]), "".join(run[p % fan + 1 :])]
        at = [H(*at[i : i + fan]) for i in range(0, len(at), fan)]
        place = [p // fan for p in place]
    return at[0], proofs


def brute_manifest(rows, fan=16):
    """rows: (doc_id, source, lang, n_chars, text); one (doc_id, leaf, subroot, root, proof_sha256) a row."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, H(*map(part, r))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s])], fan) for s in names}
    if not names:
        return []
    root, above = brute_tree([trees[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, above, strict=True):
        for (has, i, leaf), proof in zip(sorted(by[s]), trees[s][1], strict=True):
            out.append((i if has else None, leaf, trees[s][0], root, H(*proof, *top)))
    return out


def manifest_rows(rows):
    return [(i, source, lang, len(text or ""), text) for i, text, lang, source in rows]


@pytest.mark.parametrize(("fan", "levels"), [(16, 3), (2, 1), (3, 2)])
def test_manifest_against_plain_lists(spark, fan, levels):
    rng = random.Random(fan)
    rows = [(i, f"text {i} " * rng.randrange(3), "en", rng.choice(["a", "a", "a", "b", None, "é", "Z"])) for i in range(140)] + [(900, "alone", None, "lone")]
    got = merkle.merkle_manifest(documents(spark, rows), fan=fan, levels=levels).collect()
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == sorted(brute_manifest(manifest_rows(rows), fan))
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_manifest_awkward(spark):
    rows = AWKWARD * 3 + [(10 + i, "one text", "en", f"s{i % 19}") for i in range(60)]
    got = merkle.merkle_manifest(documents(spark, rows)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got), key=key) == sorted(brute_manifest(manifest_rows(rows)), key=key)
    assert merkle.merkle_manifest(documents(spark, [])).count() == 0


def test_manifest_over_many_blocks_and_one_hot_source_of_equal_rows(spark):
    rows = [(None, "same", "en", "hot")] * 700 + [(i, f"t{i}", "en", "hot") for i in range(700)] + [(i, "x", "en", f"site{i}") for i in range(700)]
    got = merkle.merkle_manifest(documents(spark, rows), fan=4, levels=2).collect()
    want = brute_manifest(manifest_rows(rows), 4)
    assert sorted(repr((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"])) for r in got) == sorted(map(repr, want))


def test_manifest_finds_changed_rows_and_its_proofs_hold(spark):
    rows = [(i, f"Text {i}" if i % 7 else None, "en", "ab"[i % 2]) for i in range(100)]
    changed = F.when(F.col("doc_id") % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    got = merkle.merkle_manifest(documents(spark, rows), claims={"text": changed}, proofs=True).collect()
    for r in got:
        assert r["verified"] == (r["doc_id"] % 5 != 0 or r["doc_id"] % 7 == 0) and r["verified"] == (r["folded_root"] == r["root"])
        steps = [p.encode() for p in r["proof"]]
        assert merkle.folded(r["leaf"].encode(), steps).decode() == r["root"] and hashlib.sha256(b"".join(steps)).hexdigest() == r["proof_sha256"]
    nulled = merkle.merkle_manifest(documents(spark, rows), claims={"text": F.lit(None).cast("string")}).collect()
    assert all(r["verified"] == (r["doc_id"] % 7 == 0) for r in nulled)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 400])
def test_sweeps_agree_with_plain_lists(n):
    leaves = [H(str(i)) for i in range(n)]
    root, proofs = brute_tree(leaves)
    height = merkle.tree_height(n, 16)
    pairs = [(i, x.encode()) for i, x in enumerate(leaves)]
    assert merkle.swept(iter(pairs), height, 16).decode() == root
    assert {i: [p.decode() for p in proof] for i, proof in merkle.proofs(pairs, height, 16, [])} == dict(enumerate(proofs))


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    grams = ([w] if 0 < len(w) < k else [w[i : i + k] for i in range(len(w) - k + 1)]) if w else []
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, most=2):
    """Component by number, over all pairs."""
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fps}


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"W{i}" for i in range(500)]
    rows = []
    for size in (200, 400):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5, 30])):
                w[rng.randrange(size)] = rng.choice(words)
            rows.append((3 * len(rows) + 7, " ".join(w), "en", "a"))
    rows += [(2000 - i, " ".join(rng.choice(words[:3]) for _ in range(rng.randrange(7))), "en", "a") for i in range(100)]
    got = {r["doc_id"]: r for r in simhash.simhash_near_duplicates(documents(spark, rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    of, least = brute_groups(fps.values()), {}
    for i, f in fps.items():
        least[of[f]] = min(least.get(of[f], i), i)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: least[of[f]] for i, f in fps.items()}
    assert len(set(least)) < len(set(fps.values())) and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@pytest.mark.parametrize(("most", "parts", "hot"), [(2, 2, 1000), (2, 3, 1000), (2, 4, 5), (3, 2, 5), (1, 3, 5), (0, 2, 1000), (2, None, 1000)])
def test_links_are_all_pairs_also_where_bits_go_together(spark, most, parts, hot):
    rng = random.Random(most * 10 + (parts or 0))
    numbers = {rng.getrandbits(64) for _ in range(150)}
    # A third shares most of its bits, and half of the bits repeat the other half.
    numbers |= {0xABCDEF0123456789 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 1 << rng.randrange(64)]) for _ in range(150)}
    numbers |= {(x := rng.getrandbits(32)) << 32 | x ^ (1 << rng.randrange(32)) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in numbers]
    fps = stored(spark.createDataFrame([(x,) for x in signed], "fp long"), "fps")
    got = [(r["q"], r["fp"]) for r in simhash.links_within(fps, most, parts, hot).collect()]
    want = {(max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_thresholds_add_up_and_shun_frequent_values():
    rng = np.random.default_rng(2)
    fp = rng.integers(-(2**63), 2**63, 15_000)
    fp[:5000] &= ~0xFFFFFFFF  # a third has one value in the low half
    x = simhash._as_bits(fp).astype(np.int64)
    parts = simhash.grouped_bits((x.T @ x).astype(float), len(fp), 2)
    assert sorted(b for p in parts for b in p) == list(range(64)) and [len(p) for p in parts] == [32, 32]
    low = next(i for i, p in enumerate(parts) if sum(b < 32 for b in p) >= 30)
    frequencies = np.array([np.bincount(simhash._values(fp, bits), minlength=256) for _, bits in simhash._slices(parts)])
    t = simhash.Allocation(parts, frequencies, len(fp), 2, {(low, 0): 5000}).thresholds(fp)
    assert (t.sum(axis=1) == 1).all() and (t >= -1).all()
    assert (t[:5000, low] == -1).mean() > 0.9 and (t[5000:, low] >= 0).mean() > 0.9


def test_simhash_awkward(spark):
    got = simhash.simhash_near_duplicates(documents(spark, AWKWARD)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(AWKWARD) and {r["component_id"] for i in (1, 2, 3) for r in by[i]} == {1} and by[1][0]["fingerprint"] == "0" * 16
    assert all(r["component_id"] is None and r["kept"] for r in by[None]) and {r["component_id"] for i in (7, 8) for r in by[i]} == {7}
    assert {r["component_id"] for r in by[4]} == {4} and len({r["fingerprint"] for r in by[4]}) == 2 and by[5][0]["fingerprint"] == f"{brute_fingerprint(LONG):016x}"
    assert simhash.simhash_near_duplicates(documents(spark, [])).count() == 0


TEXTS = [
    None, "", "\n", "\n\n", "one line", "one line\n", "a\nb", "a\nb\n", "é\n日本語\n\U0001f600x\n\n", "has <P> in it\nand more", "<M>", "<\nP>\n<S\n>", "<P\n<S\n<M\n", "\r\n\r\n", "a" * 9000, "ab\n" * 9000, LONG.replace(" word7", "\nword7"),
]


def brute_middle(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50)])
def test_fill_in_middle_against_plain_lines(spark, rate, spm):
    rows = [(i * 31 + k, t, "en", "a") for i, t in enumerate(TEXTS) for k in range(4)] + [(None, "x\ny\nz", None, None), (None, None, None, None), (5, "x\ny", "en", "a"), (5, "x\ny", "en", "a")]
    out = middle.fill_in_middle(documents(spark, rows), rate, spm)
    got = out.withColumn("restored", middle.restored_text(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_middle(r[0], r[1], rate=rate, spm=spm) for r in rows), key=key)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["restored"]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)
    assert middle.fill_in_middle(documents(spark, [])).count() == 0


def test_chunks_follow_content_and_summaries_are_exact():
    rng = random.Random(9)
    shared = bytes(rng.randrange(32, 127) for _ in range(20_000))
    ends = [middle.chunk_ends(np.frombuffer(x, np.uint8)) for x in (shared, b"some words before it " * 3 + shared)]
    chunks = [{x[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)} for x, e in zip((shared, b"some words before it " * 3 + shared), ends, strict=True)]
    assert len(chunks[0] & chunks[1]) >= 0.8 * len(chunks[0]) and len(chunks[0]) > 10
    for data in (b"", b"\n" * 5000, "日本\n".encode() * 4000, bytes(3_000_000), shared * 120):
        e = middle.chunk_ends(np.frombuffer(data, np.uint8))
        widths = np.diff([0, *e])
        assert (e[-1] if e else 0) == len(data) and (widths > 0).all() and (widths <= middle.LONGEST).all()
        memo = middle.Memo(most=4096)
        lines = middle.Lines(data, memo)
        assert lines.n == len(re.findall(rb"[^\n]*\n|[^\n]+", data)) and lines.after(lines.n) == (len(data), len(data.decode()))
    again = middle.Memo()
    middle.Lines(shared * 3, again)
    assert again.found > again.made > 10
    # Hashing in pieces changes nothing.
    whole = middle.window_hashes(np.frombuffer(shared * 60, np.uint8))
    assert [int(x) for x in np.flatnonzero(whole >> np.uint32(32 - middle.ZEROS) == 0)][:5] == [int(x) for x in np.flatnonzero(middle.window_hashes(np.frombuffer(shared, np.uint8)) >> np.uint32(32 - middle.ZEROS) == 0)][:5]
