"""Fragments of requirements in facts, and largest matchings, against plain versions."""

import random
import re
import unicodedata

from lorekeep.operators import evaluation, graph, matching

WANTS = "case_id int, requirement int, all_text array<string>, any_text array<string>, subject string, attribute string, memory_types array<string>"
FACTS = "case_id int, fact int, text string, subject string, attribute string, memory_type string"


def plain(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").lower()).strip()


def holds(text, fragment):
    needle = plain(fragment)
    if not needle:
        return False
    if re.fullmatch(r"[\w-]+", needle):
        return re.search(rf"(?:^|[^\w]){re.escape(needle)}(?:$|[^\w])", text) is not None
    return needle in text


def meets(want, fact):
    _, _, all_text, any_text, subject, attribute, kinds = want
    text = plain(fact[2])
    return not (
        any(not holds(text, f) for f in all_text or []) or any_text and not any(holds(text, f) for f in any_text)
        or subject is not None and plain(subject) != plain(fact[3]) or attribute is not None and plain(attribute) != plain(fact[4]) or kinds and fact[5] not in kinds
    )


def test_fragments_equal_the_plain_rule(spark):
    rng = random.Random(9)
    words = ["red", "Red-Fox", "fox", "well-known", "a_b", "über", "ＡＢＣ", "2024", "the", "co-op", "x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "-", ".", "(", "$1.5 "]) for _ in range(n))

    def fragment():
        kind, source = rng.random(), text(4)
        if kind < 0.4:
            return rng.choice(words)
        if kind < 0.8:
            a = rng.randrange(len(source))
            return source[a : a + rng.randint(1, 12)]
        return rng.choice(["", " ", "-", "--", "1.5", "$", "red fox", "\\E.*", ".*", None])

    some = lambda n: rng.choice([None, [], [f for _ in range(rng.randint(1, n)) if (f := fragment()) is not None]])
    maybe = lambda *of: rng.choice([None, None, None, *of])
    wants = [(c, r, some(2), some(3), maybe("Ann", " ann "), maybe("job"), rng.choice([None, [], ["fact"], ["fact", "goal"]])) for c in range(5) for r in range(30)]
    facts = [(c, f, rng.choice([None, "", text(6), text(6), text(12)]), rng.choice([None, "ann", "ANN", "Bob"]), rng.choice([None, "Job"]), rng.choice(["fact", "goal", None])) for c in range(6) for f in range(25)]
    got = {tuple(r) for r in matching.met_by(spark.createDataFrame(wants, WANTS), spark.createDataFrame(facts, FACTS)).collect()}
    want = {(w[0], w[1], f[1]) for w in wants for f in facts if w[0] == f[0] and meets(w, f)}
    assert got == want and len(want) > 200


def test_largest_matchings(spark):
    rng = random.Random(1)
    links = [(c, f"r{rng.randrange(n)}", f"f{rng.randrange(n)}") for c in range(12) for n in [rng.randint(1, 25)] for _ in range(rng.randint(1, 40))]
    # a long path, which needs augmenting from end to end
    links += [(99, f"r{k:03d}", f"f{k:03d}") for k in range(150)] + [(99, f"r{k:03d}", f"f{k - 1:03d}") for k in range(1, 150)]
    df = spark.createDataFrame(links + links[:5], "case_id int, requirement string, fact string")
    got = {r.case_id: (r.met, r.linked) for r in matching.matched(df).collect()}
    assert got == {r.case_id: (r.met, r.linked) for r in evaluation.matched_requirements(df).collect()} and got[99] == (150, 150)
    assert matching.most_matches([(1, "a"), (2, "a"), (2, "b"), (1, "b"), (3, "b")]) == 2 and matching.most_matches([]) == 0
    assert matching.matched(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    parent = {x: x for a, b in links if a is not None for x in (a, b)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
