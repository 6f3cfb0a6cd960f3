"""Words that collide under polynomials modulo 2**64 are told apart by every operator that hashes words or lines."""

import numpy as np
import pytest

from tests.llm import helpers as H
from tidewell.llm import backoff_lm, jaccard_join, line_rules, textscan, toxicity, window_dedup


def thue_morse(size):
    """A string of ``size`` letters and its complement, equal under every polynomial hash modulo 2**64 of an odd base."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(params=[1024, 2048, 8192], ids=str)
def pair(request):
    return thue_morse(request.param)


def test_they_collide_under_polynomials(pair):
    values = np.frombuffer("".join(pair).encode(), np.uint8).astype(np.uint64)
    half = len(values) // 2
    h = textscan.polynomial(values, np.array([0, half]), np.array([half, 2 * half]), textscan.BYTE_BASE)
    assert h[0] == h[1]
    g = textscan.string_hashes(values.astype(np.uint8), np.array([0, half]), np.array([half, 2 * half]))
    assert g[0] != g[1]


def test_string_hashes_tell_lengths_ends_and_seeds_apart():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3800, 20_000)
    ends = starts + rng.integers(0, 90, 20_000)
    h = textscan.string_hashes(data, starts, ends)
    other = textscan.string_hashes(data, starts, ends, seed=1)
    whole = [data[i:j].tobytes() for i, j in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(whole)) == len(set(other.tolist())) == len(set(zip(whole, h.tolist())))
    assert not (h == other).any()


def test_window_dedup(spark, pair):
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{pair[0]} {rest}"), (2, f"{pair[1]} {rest}"), (3, f"{pair[0]} {rest} tail")]
    got = {r["doc_id"]: r["n_removed"] for r in window_dedup.window_dedup(H.frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_windows_are_counted():
    """(documents, least rank) of each window decide; windows of one key and different second hashes are two."""
    u = lambda *x: np.array(x, dtype=np.uint64)
    window, documents, least = window_dedup.counted(u(5, 9, 5, 5, 9), u(1, 1, 2, 1, 1), np.array([3, 2, 0, 1, 2]), u(0, 0, 0, 2, 0))
    assert documents[window].tolist() == [4, 2, 1, 4, 2] and least[window].tolist() == [1, 2, 0, 1, 2]


def test_jaccard_join(spark, pair):
    rows = [(k, " ".join(x[0 if k == 1 else 1] for x in [pair] * 9)) for k in (1, 2)] + [(3, pair[0]), (4, pair[1])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(H.frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4)}


def test_line_rules(spark, pair):
    text = f"{pair[0]} x y\n{pair[1]} x y"
    words = "\n".join(" ".join("pq"[c == "a"] for c in half) for half in pair)  # the same with words for letters
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in line_rules.line_rules(H.frame(spark, [(1, text), (2, words)])).collect()}
    assert got[1] == (0, 0) == H.line_statistics(text)[3:]
    assert got[2] == H.line_statistics(words)[3:]


def test_backoff_lm(spark, pair):
    import zlib

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:1] + [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    rows = [(ids[0], f"{pair[0]} x"), (ids[1], f"{pair[1]} y")]
    got = {r["doc_id"]: (r["held_out"], r["n_known"]) for r in backoff_lm.score(H.frame(spark, rows)).collect()}
    assert got == {ids[0]: (False, 3), ids[1]: (True, 1)}


def test_toxicity_features(pair):
    data = " ".join(pair).encode()
    h, _, _, _, _ = toxicity.features(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    assert len(set(h[:2].tolist())) == 2
