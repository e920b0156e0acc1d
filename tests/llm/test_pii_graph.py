"""The pattern-instance graph against plain Python; recall and precision on identifiers held out of the seeds."""
import random
import string
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from lexiframe.llm import pii  # noqa: E402


def corpus(seed=3):
    """(text, what is to be found, kind) with secrets after a label; half of them in no seed's form."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    rows = []
    for _ in range(60):
        rows.append(("".join(rng.choices("0123456789abcdef", k=40)), True))
    for _ in range(40):
        rows.append((rng.choice(["sk_live_", "AKIA", "gh-", ""]) + "".join(rng.choices(string.ascii_letters, k=9))
                     + "".join(rng.choices(string.digits, k=7)), False))
    texts = [(f"{word()} {word()} {word()} {rng.choice(['token', 'token', 'key'])} = \"{s}\" {word()} {word()}", s, known)
             for s, known in rows]
    noise = [f"{word()} {word()} {word()}{rng.randint(10, 99)}release{rng.randint(10, 99)}build {word()} (see {word()}: v{rng.randint(1, 9)})"
             for _ in range(200)]
    return texts, noise


def test_recall_and_precision_of_identifiers_held_out_of_the_seeds(spark):
    texts, noise = corpus()
    rows = list(enumerate([t for t, _, _ in texts] + noise))
    got = {r["doc_id"]: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = wrong = 0
    for i, (text, secret, known) in enumerate(texts):
        spans = set(got[i]["spans"].split(",")) - {""}
        want = f"secret:{text.index(secret)}:{text.index(secret) + len(secret)}"
        assert got[i]["n_secret"] == int(known)
        hits += not known and want in spans
        wrong += len(spans - {want})
    wrong += sum(got[i]["spans"] != "" for i in range(len(texts), len(rows)))
    assert hits >= 0.9 * 40 and wrong <= 0.05 * 100, (hits, wrong)


def plain_scores(edges, rounds, support):
    """edges: (pattern, kind, found, seed); the scores of (kind, found) as the rounds give them."""
    score = {(p, k, f): float(s) for p, k, f, s in edges}
    seed = {(p, k, f): s for p, k, f, s in edges}
    for _ in range(rounds):
        by_pattern = defaultdict(list)
        for e in score:
            by_pattern[e[:2]].append(e)
        confidence = {p: sum(score[e] for e in es) / (len(es) + 1) for p, es in by_pattern.items()
                      if sum(seed[e] for e in es) >= support}
        miss = defaultdict(lambda: 1.0)
        for p, k, f in score:
            if not seed[p, k, f] and (p, k) in confidence:
                miss[k, f] *= 1 - confidence[p, k]
        score = {e: 1.0 if seed[e] else 1 - miss[e[1:]] if e[1:] in miss else 0.0 for e in score}
    return score


@pytest.mark.parametrize("rounds,support", [(1, 3), (3, 2)])
def test_graph_scores_equal_plain_python(spark, rounds, support):
    texts, noise = corpus(9)
    phones = [f"call me: +1 (555) 010-{1000 + i} now" for i in range(6)] + ["call me: 555-0134-77 now", "we sold 555-0199-88"]
    rows = list(enumerate([t for t, _, _ in texts] + noise + phones))
    spans = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    edges = {(r["pattern"], r["kind"], r["found"]): r for r in pii.score_graph(spans, rounds, support).collect()}
    want = plain_scores([(*k, r["seed"]) for k, r in edges.items()], rounds, support)
    assert len(edges) > 100 and {r["seed"] for r in edges.values()} == {0, 1}
    assert all(abs(r["score"] - want[k]) < 1e-9 for k, r in edges.items())
    seeds = {(r["kind"], r["found"]) for r in spans.selectExpr("inline(concat(base, secrets))").collect()}
    assert {k[1:] for k, r in edges.items() if r["seed"]} <= seeds


def test_contexts_and_labels(spark):
    rows = [("say hi to  Tel.: 12", "to tel.: ", "tel.: "), ("a b", "a b", ""), ("", "", ""), ("x = \"", "= \"", "x = \""),
            ("é(", "é(", "é("), ("n 5,", "n #,", "")]
    for text, words, label in rows:
        got = spark.createDataFrame([(text,)], "t string").select(pii._patterns(pii.F.col("t")).alias("p")).first()["p"]
        end = {"say hi to  Tel.: 12": ["words tel.: ##", "label "]}.get(text, [f"words {words.strip()}", f"label {label}"])
        assert got == end, (text, got)
