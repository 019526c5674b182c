"""Line dedup and near-duplicates against brute force."""

import random
import re
from collections import defaultdict

from signalspark.llm import linededup, neardup
from signalspark.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def smallest(sets, order):
    """For each name the first name, by order, that links of 75 percent lead to."""
    names = list(sets)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for n in names:
        groups[find(n)].append(n)
    return {n: min(members, key=order) for members in groups.values() for n in members}


def corpus(seed, n=70):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(12)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            words = rnd.choice(base).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            lines.append(" ".join(words).title() if rnd.random() < 0.2 else "  ".join(words))
        out.append("\n".join(lines))
    return out + ["", " \n \n", "one", "One", "two words", "\n\none\n", "w1 " * 300]


def test_near_duplicates_equal_brute_force(documents):
    for seed in range(2):
        rows = [(10 * i + 3, t) for i, t in enumerate(corpus(seed))] + [(1, None)]
        found = {r.doc_id: r for r in neardup.near_duplicates(documents(rows).repartition(5)).collect()}
        sets = {i: shingles(t) for i, t in rows}
        first = smallest(sets, order=lambda i: i)
        assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {
            i: (len(sets[i]), first[i], first[i] == i) for i in sets
        }


def test_near_duplicates_in_a_large_group(documents):
    rnd = random.Random(4)
    base = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        words[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base)) for i in range(200, 300)] + [(300, " ".join(f"b{i}" for i in range(50)))]
    found = neardup.near_duplicates(documents(rows))
    assert {r.component_id for r in found.where("doc_id < 300").collect()} == {0}
    kept = neardup.dedup(documents(rows + rows[:3]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 300]
    assert kept.columns == documents([]).columns


def test_near_duplicates_ties_nulls_and_empty_tables(documents):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (None, text), (7, None), (7, ""), (8, "x y"), (8, "p q r")]
    found = neardup.near_duplicates(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == sorted(
        [("5", 4, "5", True)] * 2 + [("None", 4, "5", False)] + [("7", 0, "7", True)] * 2 + [("8", 1, "8", True)] * 2
    )
    kept = neardup.dedup(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted(
        [("5", text), ("7", "None"), ("7", ""), ("8", "x y"), ("8", "p q r")]
    )
    assert neardup.near_duplicates(documents([])).count() == 0
    assert neardup.dedup(documents([])).count() == 0
    assert neardup.near_duplicates(documents([(1, None)])).first().kept


def test_pruning_keeps_what_may_reach_the_threshold():
    least = neardup.least_matches(neardup.Settings())
    assert len(least) == 8 and list(least) == sorted(least)
    assert least[-1] < 96 - 3 * 5  # 75 percent of 128, less than three deviations below never pruned


def test_lines_equal_brute_force(documents):
    for seed in (3, 4):
        rows = list(enumerate(corpus(seed, 40))) + [(1000, None)]
        found = linededup.similar_lines(documents(rows).repartition(4)).collect()
        sets = {(i, j): shingles(line) for i, t in rows for j, line in enumerate((t or "").split("\n"))}
        first = smallest(sets, order=lambda n: n)
        assert {(r.doc_id, r.line): (r.n_tokens, (r.first_key, r.first_line), r.removed) for r in found} == {
            n: (len(sets[n]), first[n], first[n] != n) for n in sets
        }


def test_line_links_equal_brute_force(documents):
    for seed in (3, 5):
        rows = list(enumerate(corpus(seed, 40))) + [(1000, None)]
        found = linededup.similar_lines(documents(rows).repartition(4)).collect()
        sets = {(i, j): shingles(line) for i, t in rows for j, line in enumerate((t or "").split("\n"))}
        near = {
            a: [b for b in sets if b != a and s and 100 * len(s & sets[b]) >= 75 * len(s | sets[b])] for a, s in sets.items()
        }
        assert {(r.doc_id, r.line): (r.n_links, r.repeats) for r in found} == {
            a: (len(near[a]), any(b < a for b in near[a])) for a in sets
        }
        classes = {(r.doc_id, r.line): r.class_id for r in found}
        first = smallest(sets, order=lambda n: n)
        assert all((classes[a] is None) == (not sets[a]) for a in sets)
        assert all((classes[a] == classes[b]) == (first[a] == first[b]) for a in sets for b in sets if sets[a] and sets[b])


def test_a_line_between_two_others_removes_none_of_them(documents):
    words = [f"c{i}" for i in range(44)]
    left, right = [*(f"a{i}" for i in range(5)), *words[5:]], [*words[:-5], *(f"b{i}" for i in range(5))]
    rows = [(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(words)), (4, " ".join(words))]
    found = {r.doc_id: r for r in linededup.similar_lines(documents(rows)).collect()}
    assert {i: (r.n_links, r.first_key, r.repeats) for i, r in found.items()} == {
        1: (2, 1, False), 2: (2, 1, False), 3: (3, 1, True), 4: (3, 1, True),
    }
    assert len({r.class_id for r in found.values()}) == 1
    assert sorted(r.doc_id for r in linededup.dedup_lines(documents(rows)).collect()) == [1, 2]


def test_lines_are_taken_out(documents):
    line, other = "one two three four five six seven eight", "a b c d e f g"
    rows = [(1, f"{line}\n\nx"), (2, f"y\n{line.upper()}\nz"), (3, line), (4, None), (5, ""), (6, f"{other}\n{other}")]
    rows += [(None, f"null\n{line}"), (7, f"q\n{line}"), (7, f"q\n{line}")]
    found = linededup.dedup_lines(documents(rows))
    assert found.columns == documents([]).columns
    # A null key comes first, so it keeps the line.
    assert sorted((str(r.doc_id), str(r.text)) for r in found.collect()) == sorted(
        [("None", f"null\n{line}"), ("1", "\nx"), ("2", "y\nz"), ("4", "None"), ("5", ""), ("6", other), ("7", "q"), ("7", "q")]
    )
    assert linededup.dedup_lines(documents([])).count() == 0


def test_a_line_that_many_documents_share(documents):
    rows = [(i, f"own line number {i} of this document here\nthe very same line in all of them") for i in range(300)]
    found = linededup.similar_lines(documents(rows).repartition(6))
    assert found.where("removed").count() == 299
    assert found.where("removed and (first_key <> 0 or first_line <> 1)").count() == 0


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(1, 200)]
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {n: find(n) for pair in pairs for n in pair if pair[0] != pair[1]} | {
        n: find(n) for n in found
    }
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_full_sets_are_made_for_pairs_only(documents, monkeypatch):
    """Lines that share a token but are too different to be similar need no full sets; the texts give lines and rarity at once."""
    head, seen = "one two three four five", {}

    def spy(df, name, *more):
        seen[name] = made = landed(df, name, *more)
        return made

    landed = linededup.landed
    monkeypatch.setattr(linededup, "landed", spy)
    rows = [(i, head + "".join(f" w{i}x{j}" for j in range(12))) for i in range(6)] + [(9, "a b c d e f g h"), (8, "a b c d e f g h i")]
    found = {r.doc_id: r for r in linededup.similar_lines(documents(rows)).collect()}
    assert {k for k, r in found.items() if r.n_links} == {8, 9} and found[9].removed and not found[8].removed
    assert seen["line-sets"].count() == 2
    assert seen["lines"].where("slot IS NOT NULL").count() > 0
