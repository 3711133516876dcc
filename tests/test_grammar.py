"""Gene decoding: against an exhaustive search, one pass against blocks, and gene models from paths."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import grammar
from locusframe.plans.gene_queries import base_scores

MOVES = grammar.gene_moves(8, 6, 12)


def random_scores(seed):
    """Scores that depend on the seed and on each base with its neighbours."""

    def scorer(sequences):
        letters = np.frombuffer("".join(sequences).encode(), np.uint8).reshape(len(sequences), -1).astype(np.int64)
        near = letters * 7 + np.roll(letters, 1, axis=1) * 3 + np.roll(letters, -1, axis=1)
        return (near[..., None] * (seed + 31 * np.arange(15) + 1) * 2_654_435 % 4_000_001) - 2_000_000

    return scorer


def allowed(sequence, path):
    """Whether a path of states follows the grammar and what the letters say, by rules written out."""
    s = "NN" + sequence.upper() + "NN"
    before = 0
    for t, state in enumerate(path):
        at = t + 2
        if state not in grammar.STEPS[before]:
            return False
        if state == 7 and s[at : at + 3] != "ATG":
            return False
        if state == 14 and s[at - 2 : at + 1] not in ("TAA", "TAG", "TGA"):
            return False
        if state in (8, 9, 10) and s[at + 1 : at + 3] not in ("GT", "GC"):
            return False
        if state in (11, 12, 13) and s[at - 2 : at] != "AG":
            return False
        if before == 5 and state in (6, 9) and s[at - 2 : at + 1] in ("TAA", "TAG", "TGA"):
            return False
        before = state
    return path[-1] in (0, 14)


def all_paths(n):
    def grow(path):
        if len(path) == n:
            yield path
            return
        for state in grammar.STEPS[path[-1] if path else 0]:
            yield from grow([*path, state])

    return grow([])


def value(sequence, path, scorer):
    scores = scorer(["NN" + sequence + "NN"])[0, 2:-2]
    return int(sum(MOVES[a, b] for a, b in itertools.pairwise([0, *path])) + sum(scores[t, s] for t, s in enumerate(path)))


@pytest.mark.parametrize("sequence", ["ATGTAA", "CATGAAATAGC", "ATGGTAGTAA", "atgGTcAGtaac", "AATGGTAAGATTAAG", "NNNN", "A"])
def test_one_pass_is_exhaustive(sequence):
    for seed in (1, 9, 77):
        scorer = random_scores(seed)
        found, path = grammar.decode(sequence, scorer, MOVES)
        every = [value(sequence, p, scorer) for p in all_paths(len(sequence)) if allowed(sequence, p)]
        assert allowed(sequence, path.tolist()) and found == max(every) == value(sequence, path.tolist(), scorer)


def genome(rng, n):
    return "".join(rng.choice(list("ACGTacgtN"), n, p=[0.2, 0.18, 0.18, 0.2, 0.06, 0.06, 0.06, 0.05, 0.01]))


def expected(sequences, scorer, moves=MOVES):
    """Runs of one pass over each sequence and its reverse complement."""
    turn = str.maketrans("ACGTNacgtn", "TGCANtgcan")
    out = {}
    for name, sequence in sequences.items():
        for strand in "+-":
            score, path = grammar.decode(sequence if strand == "+" else sequence.translate(turn)[::-1], scorer, moves)
            out[name, strand] = (score, [(k, b + 1, e + 1) for k, b, e, _, _ in grammar.path_runs(path)])
    return out


@pytest.mark.parametrize("size", [5, 37, 400, 5_000])
def test_blocks_are_one_pass(spark, size):
    rng = np.random.default_rng(3)
    sequences = {"a": genome(rng, 2_500), "b": genome(rng, 401), "c": "ATGTAA", "d": "A", "e": genome(rng, 400)}
    scorer = random_scores(5)
    table = spark.createDataFrame([*sequences.items(), ("none", "")], "seq_name string, sequence string")
    blocks = grammar.decoded_blocks(table, scorer, MOVES, size, margin=3)
    scores = {(r["seq_name"], r["strand"]): r["score"] for r in blocks.where("score is not null").collect()}
    pieces = grammar.path_pieces(blocks).select("seq_name", "strand", "kind", "start", "stop").orderBy("start").collect()
    runs = {k: [] for k in scores}
    for name, strand, kind, start, stop in pieces:
        own = runs[name, strand]
        if own and own[-1][0] == kind and own[-1][2] == start - 1:
            own[-1] = (kind, own[-1][1], stop)
        else:
            own.append((kind, start, stop))
    # The scorer sees one base on each side, at a sequence's end an N.
    assert {k: (scores[k], runs[k]) for k in scores} == expected(sequences, scorer)
    assert size < 5_000 or all(len(r) > 3 for (n, _), r in runs.items() if n == "a")


def test_genes_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(11)
    table = spark.createDataFrame([(f"s{i}", genome(rng, 3_000).upper()) for i in range(4)], "seq_name string, sequence string")
    moves = grammar.gene_moves(40, 60, 150)
    one, other = (sorted(map(tuple, grammar.annotated_genes(table, base_scores, moves, size, least=30).collect())) for size in (64, 10_000))
    assert one == other and len({r[3] for r in one}) > 5 and {r[1] for r in one} == {"+", "-"}
    sequences = dict(map(tuple, table.collect()))
    turn = str.maketrans("ACGT", "TGCA")
    for tx in {r[3] for r in one}:
        parts = sorted((r[5], r[6]) for r in one if r[3] == tx)
        name, strand = next((r[0], r[1]) for r in one if r[3] == tx)
        coded = "".join(sequences[name][a - 1 : b] for a, b in parts)
        coded = coded if strand == "+" else coded.translate(turn)[::-1]
        assert coded[:3] == "ATG" and coded[-3:] in ("TAA", "TAG", "TGA") and len(coded) % 3 == 0 and len(coded) >= 30
        assert not {"TAA", "TAG", "TGA"} & {coded[i : i + 3] for i in range(0, len(coded) - 3, 3)}


def smooth(sequences):
    """Scores by the bases around each place, as far as the given stretch goes: cut stretches are scored otherwise at their ends."""
    out = base_scores(sequences)
    total = np.cumsum(np.pad(out, ((0, 0), (1, 0), (0, 0))), axis=1)
    n = out.shape[1]
    low, high = np.maximum(np.arange(n) - 12, 0), np.minimum(np.arange(n) + 13, n)
    return (total[:, high] - total[:, low]) // (high - low)[None, :, None]


def test_second_prediction_is_decoded_in_its_window(spark):
    rng = np.random.default_rng(21)
    sequences = {f"s{i}": genome(rng, n).upper() for i, n in enumerate((900, 640, 131))}
    table = spark.createDataFrame(list(sequences.items()), "seq_name string, sequence string")
    moves, size, margin = grammar.gene_moves(40, 60, 60), 128, 2
    first = grammar.decoded_blocks(table, smooth, moves, size, margin)
    rows = {(r["seq_name"], r["strand"], r["block"]): r for r in first.collect()}

    def states(pieces, total):
        """The path, from runs, by the grammar's frames."""
        out = np.zeros(total + 1, int)
        for kind, start, stop, head, tail in pieces:
            out[start : stop + 1] = kind if kind < 4 else 4 + (grammar.FRAME[head] + np.arange(stop - start + 1)) % 3
            out[start], out[stop] = head, tail
        return out[1:]

    turn = str.maketrans("ACGTN", "TGCAN")
    wanted, codes = {}, {}
    for name, sequence in sequences.items():
        for strand in "+-":
            own = sequence if strand == "+" else sequence.translate(turn)[::-1]
            n, mine = len(own), sorted((b, r) for (a, s, b), r in rows.items() if (a, s) == (name, strand))
            path = states([tuple(x) for _, r in mine for x in r["runs"]], n)
            new = path.copy()
            for _, r in mine[1:]:
                at = r["runs"][0]["start"]
                if path[at - 2] == 0 or path[at - 1] == 0:
                    continue
                plus = at if strand == "+" else n + 2 - at
                codes[name, plus] = codes.get((name, plus), set()) | {strand}
                low, high = max(1, at - size // 2), min(n, at + size // 2 - 1)
                padded = "NN" + own + "NN"
                stretch = padded[low - 1 : high + 4]
                scores, stops = grammar.masked_scores(smooth([stretch])[:, 2:-2], np.frombuffer(stretch.encode(), np.uint8)[None])
                entry = np.full((1, 1, 15), grammar.NEVER)
                entry[0, 0, path[low - 2] if low > 1 else 0] = 0
                size_ = np.array([high - low + 1])
                _, back = grammar.forward(entry, scores, stops, size_, moves, keep=True)
                new[low - 1 : high] = grammar.paths(back, size_, np.array([[path[high - 1]]]))[0, 0, 1:]
            wanted[name, strand] = new.tolist()
    found = {}
    for r in grammar.predicted_again(table, first, smooth, moves, size, margin).collect():
        found.setdefault((r["seq_name"], r["strand"]), []).append((r["kind"], r["start"], r["stop"], r["first"], r["last"]))
    assert {k: states(v, len(sequences[k[0]])).tolist() for k, v in found.items()} == wanted
    assert codes and any(wanted[k] != states([tuple(x) for b in sorted(b for a, s, b in rows if (a, s) == k) for x in rows[*k, b]["runs"]], len(sequences[k[0]])).tolist() for k in wanted)
    code = {k: 2 if len(v) == 2 else int("-" in v) for k, v in codes.items()}
    table_2 = grammar.blocks(table, size, margin)
    assert {(r["seq_name"], r["window"]): r["code"] for r in grammar.doubtful(first, table_2, size).collect()} == code
    # Named borders alone are decoded again, on the strands of their codes.
    none = spark.createDataFrame([], "seq_name string, window long, code int")
    same = {}
    for r in grammar.predicted_again(table, first, smooth, moves, size, margin, none).collect():
        same.setdefault((r["seq_name"], r["strand"]), []).append((r["kind"], r["start"], r["stop"], r["first"], r["last"]))
    assert all(states(v, len(sequences[k[0]])).tolist() == states([tuple(x) for b in sorted(b for a, s, b in rows if (a, s) == k) for x in rows[*k, b]["runs"]], len(sequences[k[0]])).tolist() for k, v in same.items())


def test_class_scores_spread_epsilon():
    p = np.zeros((1, 2, 15))
    p[0, 0, 3], p[0, 1, 7] = 1.0, 0.5
    got = grammar.class_scores(p, 0.14) / grammar.UNIT
    assert np.allclose(np.exp(got[0, 0, [3, 0]]), [0.86, 0.01], rtol=1e-4) and np.allclose(np.exp(got[0, 1, [7, 0]]), [0.43, 0.005], rtol=1e-4)


def test_packed_batches_are_bounded():
    lengths = np.array([5, 100, 7, 7, 0, 3, 2_000])
    parts = list(grammar.packed(lengths, 210))
    assert sorted(np.concatenate(parts).tolist()) == list(range(7))
    assert all(len(p) == 1 or len(p) * lengths[p].max() <= 210 for p in parts)


def test_empty_table(spark):
    none = spark.createDataFrame([], "seq_name string, sequence string")
    assert grammar.annotated_genes(none, base_scores, MOVES).count() == 0
    with pytest.raises(ValueError):
        grammar.blocks(none.withColumn("x", F.lit(1)), 10, 1)


def test_whole_sequences_are_their_blocks(spark):
    rng = np.random.default_rng(8)
    texts = [genome(rng, n) for n in (1, 6, 63, 64, 65, 128, 500, 911)] + ["ATGTAA"]
    table = spark.createDataFrame([*((f"s{i}", x) for i, x in enumerate(texts)), ("none", ""), ("null", None)], "seq_name string, sequence string")
    rows = lambda whole: sorted(map(tuple, grammar.decoded_blocks(table, smooth, grammar.gene_moves(40, 60, 60), 64, 3, whole=whole).collect()), key=str)
    assert rows(1 << 13) == rows(0) == rows(64)
    plan = grammar.decoded_blocks(table, smooth, MOVES, 64, 3)._jdf.queryExecution().executedPlan().toString()
    # One pass in a task: no matrices, vectors or paths of blocks are joined.
    assert "Join" not in plan and plan.count("MapInArrow") == 1
