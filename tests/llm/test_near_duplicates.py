import random
import re

import numpy as np
import pytest

from embervane.llm import jaccard_join, substring

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = W.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        words[i] = f"e{r.randrange(10**6)}"
    return words


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, docs_of, prose, k, percent):
    r, rows, n = random.Random(k), [], 0
    for group in range(6):  # families whose members lie on both sides of the threshold
        words = prose(group, 60 + 40 * group).split(" ")
        for _ in range(14):
            words = edited(r, words, r.choice((0, 1, 1, 2))) if r.random() < 0.6 else words
            rows.append((n, " ".join(edited(r, words, r.choice((0, 1, 2, 3))))))
            n += 1
    passage = prose("shared", 60)
    rows += [(n + i, f"{prose(100 + i, 50)} {passage} {prose(200 + i, 40)}") for i in range(20)]
    n += 20
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Two Words"), (n + 4, "two\nwords"), (n + 5, "one"), (n + 6, rows[3][1]), (n + 7, prose("long", 20_000))]
    r.shuffle(rows)
    got = jaccard_join.near_duplicates(docs_of(rows), k, percent).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == components(rows, k, percent)


def test_a_group_that_pivots_do_not_reach_is_joined_by_regions(spark, docs_of, prose):
    """A chain: neighbours link, ends are far apart, so links hang on members that are no pivots."""
    words, rows = prose("chain", 120).split(" "), []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = [*words[2:], f"n{2 * i}", f"n{2 * i + 1}"]
    got = jaccard_join.near_duplicates(docs_of(rows), 4, 85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == components(rows, 4, 85)


def test_contained_sets_that_carry_a_shared_passage(spark, docs_of, prose):
    """A text and extended forms of it: what one has in its prefix lies beyond the shorter common part of another's prefix."""
    passage, rows = prose("passage", 48), []
    for i in range(40):  # so that no member of the families below is a pivot at the first level
        rows.append((len(rows), f"{prose(1000 + i, 20)} {passage} {prose(2000 + i, 20)}"))
    for family in range(8):
        base = f"{prose(3000 + family, 47)} {passage}"
        rows.append((len(rows), base))
        for i in range(5):
            rows.append((len(rows), f"{base} {prose(4000 + 10 * family + i, 9)}"))
    for i in range(40):  # single pairs
        base = f"{prose(5000 + i, 47)} {passage}"
        rows += [(len(rows), base), (len(rows) + 1, f"{base} {prose(6000 + i, 8 + i % 5)}")]
    got = jaccard_join.near_duplicates(docs_of(rows), 4, 85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == components(rows, 4, 85)


def test_ids_that_repeat_or_are_null(spark, docs_of, prose):
    a, b = prose("a", 40), prose("b", 40)
    rows = [(5, a), (5, a), (5, b), (7, b), (None, a), (9, "x")]
    got = jaccard_join.near_duplicates(docs_of(rows), 4, 85).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in got) == [(-1, -1), (5, 5), (5, 5), (5, 5), (7, 5), (9, 9)]
    assert jaccard_join.near_duplicates(docs_of([(1, "x")]).limit(0), 4, 85).count() == 0


def removed(rows, window):
    first, out = {}, {}
    for d, t in sorted(rows):
        w, own = W.findall(t or ""), []
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            own.append(g)
            if first.get(g, d) < d:
                keep[i : i + window] = [False] * window
        for g in own:
            first.setdefault(g, d)
        out[d] = " ".join(x for x, k in zip(w, keep) if k)
    return out


def test_substrings_equal_brute_force(spark, docs_of, prose):
    r, rows = random.Random(1), []
    shared = [prose(f"s{i}", 55 + 10 * i) for i in range(4)]
    for i in range(60):
        parts = [prose(i * 10 + j, r.randrange(1, 60)) for j in range(3)]
        for s in r.sample(shared, r.randrange(3)):
            w = s.split(" ")
            a = r.randrange(len(w) // 2)
            parts.insert(r.randrange(4), " ".join(w[a : a + r.randrange(40, 80)]))
        rows.append((i, r.choice((" ", "\n", " \t ")).join(parts)))
    rows += [(60, rows[2][1]), (61, rows[2][1]), (62, None), (63, ""), (64, "a " * 300), (65, "a " * 200), (66, prose("long", 30_000)), (67, prose(1, 49)), (68, prose(1, 49))]
    got = {x.doc_id: x for x in substring.dedup_substrings(docs_of(rows)).collect()}
    want = removed(rows, 50)
    assert len(got) == len(rows)
    for d, kept in want.items():
        assert got[d].kept == kept, d
        assert sum(s.end - s.start for s in got[d].removed) == got[d].n_removed == got[d].n_words - len(kept.split())
    assert substring.dedup_substrings(docs_of([(1, "x")]).limit(0)).count() == 0


def test_substrings_of_rows_that_share_an_id(spark, docs_of, prose):
    a, b = prose("p", 80), prose("q", 80)
    got = substring.dedup_substrings(docs_of([(1, a), (1, b), (2, f"{b} tail"), (None, a)])).collect()
    assert sorted((x.doc_id or -1, x.n_removed) for x in got) == [(-1, 0), (1, 0), (1, 0), (2, 80)]


def test_parity_is_a_lower_bound_of_the_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 3000, int(r.integers(1, 900)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        bits = sum(int(x).bit_count() for x in jaccard_join.parity(a) ^ jaccard_join.parity(b))
        assert bits <= len(np.setxor1d(a, b))
    assert not (jaccard_join.parity(a) ^ jaccard_join.parity(a.copy())).any()


def test_a_group_of_edited_copies_that_no_pivot_reaches(spark, docs_of, prose):
    r, base = random.Random(5), prose(77, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(len(w)), 2 + i % 4):
            w[at] = f"w{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(docs_of(rows), 4, 85).collect())
    assert got == components(rows, 4, 85)
