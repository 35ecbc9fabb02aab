
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import entry_oracles as oracles  # noqa: E402
from lexweave.functions import vectors  # noqa: E402
from lexweave.operators import (  # noqa: E402
    compose,
    cooc,
    lowrank,
    matching,
    matrix,
    phrases,
    ridge,
    rules,
    store,
    trees,
    vocab,
)
from lexweave.plans.phrases import build_phrases  # noqa: E402
from lexweave.plans.train import build_space, phrase_space, train  # noqa: E402
from lexweave.plans.words import plain_words, tagged_words  # noqa: E402
from lexweave.session import cut_lineage  # noqa: E402
from lexweave.sources import corpus, observed, standin, text_formats  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
VOCAB, DIM, SMALL, CUT_RANK = oracles.VOCAB, oracles.DIM, oracles.SMALL, oracles.CUT_RANK


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table may be one file with one row group: it is dealt over the cores, a larger one over more partitions."""
    return corpus.documents(spark, sf_dir, spark.sparkContext.defaultParallelism)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines_of(_documents(spark, sf_dir))


def _parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.parsed_text(_lines(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.parse_lines(_parsed_text(spark, sf_dir))


def _tagged(spark: SparkSession, sf_dir: str, dim: int = DIM):
    return tagged_words(_parsed(spark, sf_dir), vocab_size=VOCAB, dim=dim)


def _round(value: str | Column, places: int = 6) -> Column:
    """Rounded, with negative zero as zero."""
    rounded = F.round(value, places)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _round(n) for n in names})


def tokens_plain(spark, sf_dir):
    return vocab.plain_token_rows(_lines(spark, sf_dir))


def tokens_tagged(spark, sf_dir):
    return corpus.token_rows(_parsed_text(spark, sf_dir))


def deps_decoded(spark, sf_dir):
    return corpus.edge_rows(_parsed_text(spark, sf_dir))


def parsed_dropped(spark, sf_dir):
    """Tokens and edges seen and kept while the parsed corpus is written."""
    _, seen = observed.parse_observed(_parsed_text(spark, sf_dir))
    return spark.createDataFrame(list(seen.items()), "kind string, total bigint")


def pairs_plain_filtered(spark, sf_dir):
    """``pairs_plain`` for a vocabulary beyond a broadcast: a filter of its words, then a shuffled join."""
    job = plain_words(_lines(spark, sf_dir))
    sequences = cooc.plain_sequences(job.tokens, job.vocab, job.window, max_broadcast_rows=0)
    return cooc.spell_pairs(cooc.plain_index_pair_counts(sequences, job.window), job.vocab)


def rule_tokens_by_range(spark, sf_dir):
    """``rule_tokens`` with all phrases placed as long ones are."""
    docs = _documents(spark, sf_dir)
    placed = trees.phrase_sentences(standin.rule_phrases(docs), standin.rule_sentences(docs), inline_places=-1)
    return trees.rule_tokens(placed)


def word_counts(spark, sf_dir):
    return vocab.tagged_word_counts(_parsed(spark, sf_dir))


def corpus_totals(spark, sf_dir):
    plain = plain_words(_lines(spark, sf_dir))
    # Written once: four of the totals read it, and only one of them needs contexts.
    parsed = cut_lineage(_parsed(spark, sf_dir))
    instances = phrases.phrase_rows(parsed)
    with_contexts = phrases.phrase_rows(parsed, cooc.WINDOW)

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), F.col("total").cast("bigint").alias("total"))

    def by_label(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.concat_ws("_", F.lit(name), "label").alias("kind"), "total")

    return (
        kind(vocab.plain_total(plain.tokens), "plain_words")
        .unionByName(kind(vocab.tagged_total(parsed), "tagged_words"))
        .unionByName(kind(cooc.plain_pair_total(plain.sequences()), "plain_pairs"))
        .unionByName(kind(cooc.tagged_pair_total(parsed), "tagged_pairs"))
        .unionByName(by_label(phrases.phrase_totals(instances), "phrases"))
        .unionByName(by_label(phrases.context_totals(with_contexts), "contexts"))
    )


def vocab_lex_index(spark, sf_dir):
    return plain_words(_lines(spark, sf_dir)).vocab.select("term", "cnt", "idx")


def vocab_freq_topk(spark, sf_dir):
    return vocab.frequency_vocab(word_counts(spark, sf_dir), VOCAB)


def pairs_plain(spark, sf_dir):
    job = plain_words(_lines(spark, sf_dir))
    return cooc.spell_pairs(job.index_pairs(), job.vocab)


def pairs_tagged(spark, sf_dir):
    return cooc.tagged_pair_counts(_parsed(spark, sf_dir))


def ppmi_plain(spark, sf_dir):
    return _rounded(plain_words(_lines(spark, sf_dir)).ppmi(), "val")


def ppmi_words(spark, sf_dir):
    return _rounded(_tagged(spark, sf_dir).ppmi(), "val")


def phrase_instances(spark, sf_dir):
    return phrases.phrase_rows(_parsed(spark, sf_dir))


def phrase_counts(spark, sf_dir):
    return build_phrases(_tagged(spark, sf_dir)).vocab.select("label", "w1", "w2", "cnt")


def phrase_vocab_index(spark, sf_dir):
    return build_phrases(_tagged(spark, sf_dir), min_count=5).vocab


def phrase_contexts(spark, sf_dir):
    return phrases.context_counts(phrases.phrase_rows(_parsed(spark, sf_dir), cooc.WINDOW))


def ppmi_phrases(spark, sf_dir):
    return _rounded(build_phrases(_tagged(spark, sf_dir), min_count=5).ppmi(), "val")


def sparse_vectors(spark, sf_dir):
    vectors = matrix.sparse_vectors(plain_words(_lines(spark, sf_dir)).ppmi())
    placed = vectors.select("idx", "segment", F.posexplode("entries").alias("place", "e"))
    return placed.select("idx", "segment", F.col("place").cast("bigint").alias("place"), "e.*")


def coo_binary(spark, sf_dir):
    return matrix.load_matrix(_tagged(spark, sf_dir).ppmi())


def coo_symmetric(spark, sf_dir):
    return matrix.load_symmetric(plain_words(_lines(spark, sf_dir)).ppmi())


def matrix_stats(spark, sf_dir):
    return matrix.matrix_stats(coo_binary(spark, sf_dir))


def word_cosine(spark, sf_dir):
    words = _tagged(spark, sf_dir)
    loaded = cut_lineage(matrix.load_matrix(words.ppmi()))
    counts = phrases.phrase_counts(phrases.phrase_rows(words.parsed))
    return _rounded(
        matrix.word_cosine(vocab.at_least(counts, 5), loaded, words.vocab), "cosine"
    )


def _embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.withColumn("embedding", F.col("embedding").cast("array<double>"))


def dense_cosine(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = rows.join(following, "vec_id")
    return _rounded(
        both.select(
            "vec_id",
            vectors.signed_cosine(F.col("embedding"), F.col("next")).alias("cosine"),
            vectors.absolute_cosine(F.col("embedding"), F.col("next")).alias("absolute"),
        ),
        "cosine",
        "absolute",
    )


def normalise_vectors(spark, sf_dir):
    unit = _embeddings(spark, sf_dir).select(
        "vec_id", vectors.normalise(F.col("embedding")).alias("vec")
    )
    cells = unit.where(F.col("vec").isNotNull()).select(
        "vec_id", F.posexplode("vec").alias("place", "val")
    )
    return _rounded(cells, "val").withColumn("place", F.col("place").cast("bigint"))


def _small_matrix(spark, sf_dir):
    return cut_lineage(matrix.load_matrix(_tagged(spark, sf_dir, SMALL).ppmi()))


def svd_rank_cut(spark, sf_dir):
    """A rank far below the matrix's: orthonormal U and V, U'AV the singular values, less energy than A.

    The best subspace of this rank holds at least the energy of as many columns, the largest ones; a
    subspace that is orthonormal but not near the leading one holds less.
    """
    cells = cut_lineage(matrix.load_matrix(_tagged(spark, sf_dir).ppmi()))
    svd = lowrank.randomized_svd(cells, CUT_RANK)
    rank = len(svd.values)
    left, right = cut_lineage(svd.left), cut_lineage(svd.right)
    identity = np.eye(rank)
    off = [float(np.abs(lowrank.gram(side, identity, identity) - identity).max()) for side in (left, right)]
    projected = lowrank.product(cells, "col", "row", left, rank).withColumnRenamed("vec", "image")
    core = lowrank.gram(projected.join(right, "idx"), identity, identity, "image", "vec")
    gap = float(np.abs(core - np.diag(svd.values)).max() / svd.values.max())
    energy = F.lit(float((svd.values**2).sum()))
    columns = cells.groupBy("col").agg(F.sum(F.col("val") * F.col("val")).alias("own"))
    largest = float(sum(r.own for r in columns.orderBy(F.desc("own")).limit(CUT_RANK).collect()))
    return cells.agg(F.sum(F.col("val") * F.col("val")).alias("total")).select(
        F.lit(rank).alias("rank"),
        _round(F.lit(off[0])).alias("left_off"),
        _round(F.lit(off[1])).alias("right_off"),
        _round(F.lit(gap)).alias("middle_off"),
        (energy <= F.col("total")).alias("within"),
        (energy >= F.lit(largest)).alias("leading"),
        F.round(F.lit(largest), 6).alias("largest"),
        F.round("total", 6).alias("total"),
    )


def _rebuilt(cells: DataFrame, factors: lowrank.Factors, values) -> DataFrame:
    """The factorisation's value at every stored cell."""
    weights = F.array(*[F.lit(float(v)) for v in values])
    left = factors.left.select(F.col("idx").alias("row"), F.col("vec").alias("u"))
    right = factors.right.select(F.col("idx").alias("col"), F.col("vec").alias("v"))
    scaled = F.zip_with("v", weights, lambda a, b: a * b)
    joined = cells.select("row", "col").join(left, "row").join(right, "col")
    return _rounded(joined.select("row", "col", vectors.dot(F.col("u"), scaled).alias("val")), "val")


def randomized_svd(spark, sf_dir):
    cells = _small_matrix(spark, sf_dir)
    svd = lowrank.randomized_svd(cells, SMALL)
    return _rebuilt(cells, svd, svd.values)


def randomized_eigen(spark, sf_dir):
    cells = _small_matrix(spark, sf_dir).where(F.col("col") < SMALL)
    eigen = lowrank.randomized_eigen(cells, SMALL)
    return _rebuilt(cells, eigen, eigen.values)


def randomized_pca(spark, sf_dir):
    cells = _small_matrix(spark, sf_dir)
    pca = lowrank.randomized_pca(cells, SMALL)
    return _rebuilt(cells, pca, [1.0] * len(pca.values))


def _space(spark, sf_dir):
    words = _tagged(spark, sf_dir, SMALL)
    return words, build_space(words.ppmi(), words.vocab, SMALL)


def word_vectors(spark, sf_dir):
    _, space = _space(spark, sf_dir)
    own = space.word_vectors.select("idx", "vec")
    following = own.select((F.col("idx") - 1).alias("idx"), F.col("vec").alias("next"))
    cosine = vectors.signed_cosine(F.col("vec"), F.col("next")).alias("next_cosine")
    return _rounded(own.join(following, "idx").select("idx", cosine), "next_cosine")


def phrase_vectors(spark, sf_dir):
    words, space = _space(spark, sf_dir)
    built = build_phrases(words, min_count=5)
    modifiers = ridge.oriented(built.vocab).select("label", "idx", "word")
    word_vecs = space.word_vectors.select(F.col("term").alias("word"), F.col("vec").alias("m"))
    rows = phrase_space(built.ppmi(), space).join(modifiers, ["label", "idx"]).join(word_vecs, "word")
    return _rounded(
        rows.select(
            "label",
            "idx",
            vectors.dot(F.col("vec"), F.col("vec")).alias("norm2"),
            vectors.dot(F.col("vec"), F.col("m")).alias("along_modifier"),
        ),
        "norm2",
        "along_modifier",
    )


def _trained(spark, sf_dir):
    words, space = _space(spark, sf_dir)
    built = build_phrases(words, min_count=5)
    return train(built.vocab, built.ppmi(), space, ridge.training_list(built.vocab, 3))


def train_samples(spark, sf_dir):
    rows = _trained(spark, sf_dir).samples
    return rows.select(
        "label",
        "word",
        "arg",
        _round(vectors.dot(F.col("p"), F.col("p")), 5).alias("p_norm2"),
        _round(vectors.dot(F.col("p"), F.col("a")), 5).alias("p_along_a"),
    )


def _planar_samples(spark, sf_dir):
    e = F.col("embedding")
    return _embeddings(spark, sf_dir).select(
        "label",
        "vec_id",
        F.array(F.get(e, F.lit(2)), F.get(e, F.lit(3))).alias("p"),
        F.array(F.get(e, F.lit(0)), F.get(e, F.lit(1))).alias("a"),
    )


def ridge_modifiers(spark, sf_dir):
    fits = ridge.ridge_fits(_planar_samples(spark, sf_dir), ["label"], ["vec_id"])
    cells = {
        f"m{i + 1}{j + 1}": _round(F.get(F.get("mat", F.lit(i)), F.lit(j)))
        for i in range(2)
        for j in range(2)
    }
    return _rounded(fits, "residual", "s_trace").withColumns(cells).drop("mat", "err")


def gcv_lambda(spark, sf_dir):
    best = ridge.ridge_fits(
        _planar_samples(spark, sf_dir), ["label"], ["vec_id"], best_only=True
    )
    return _rounded(best.select("label", "lam", "err"), "err")


def _normal_equations(samples: pa.Table, fitted: pa.Table) -> pa.Table:
    """How far a fitted matrix M is from M (G + lam I) = H, and whether no other lam has a smaller error."""
    row = fitted.to_pylist()[0]
    matrix, size = np.array(row["mat"]), len(row["mat"])
    p, a = (np.array(samples.column(c).to_pylist()).reshape(-1, size) for c in "pa")
    gram, cross = a.T @ a, p.T @ a
    errors = []
    for lam in ridge.LAMBDAS:
        other = cross @ np.linalg.inv(gram + lam * np.eye(size))
        trace = float(np.trace(gram @ np.linalg.inv(gram + lam * np.eye(size))))
        below = max(len(a), 1) * (1 - trace / max(len(a), 1)) ** 2
        errors.append(((p - a @ other.T) ** 2).sum() / below)
    least = errors[ridge.LAMBDAS.index(row["lam"])] <= min(errors) * (1 + 1e-9) + 1e-12
    off = float(np.abs(matrix @ (gram + row["lam"] * np.eye(size)) - cross).max())
    out = {
        "label": row["label"], "word": row["word"], "n_samples": len(a), "a_norm2": float((a * a).sum()),
        "p_along_a": float((p * a).sum()), "off_normal": off, "gcv_least": bool(least),
    }
    return pa.table({k: [v] for k, v in out.items()})


def train_modifiers(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    return _checked_fits(trained.samples, cut_lineage(trained.modifiers))


def _checked_fits(samples: DataFrame, modifiers: DataFrame) -> DataFrame:
    keys = ["label", "word"]
    schema = "label string, word string, n_samples bigint, a_norm2 double, p_along_a double, off_normal double, gcv_least boolean"
    checked = samples.select(*keys, "p", "a").groupBy(*keys).cogroup(modifiers.groupBy(*keys))
    rows = checked.applyInArrow(_normal_equations, schema)
    places = {"a_norm2": 4, "p_along_a": 4, "off_normal": 6}
    return rows.withColumns({name: _round(name, n) for name, n in places.items()})


def ridge_full(spark, sf_dir):
    """All 64 components: the first half as arguments, the second as targets."""
    e = F.col("embedding")
    samples = _embeddings(spark, sf_dir).select(
        F.lit("full").alias("label"), F.col("label").cast("string").alias("word"), F.col("vec_id").alias("arg"),
        F.slice(e, 33, 32).alias("p"), F.slice(e, 1, 32).alias("a"),
    )
    fits = ridge.ridge_fits(samples, ["label", "word"], ["arg"], best_only=True)
    return _checked_fits(samples, fits)


def _planar_parts(spark, sf_dir):
    """Trees over the embeddings' first two components, with the matrices fitted to them.

    ``oracles.PLANAR_SIZE`` following rows make a fragment, every row one node of it, and the last fragment has
    what is left. A word takes the matrix of its row's label; some labels have none for objects, and some
    fragments have an unknown word more.
    """
    table = _embeddings(spark, sf_dir)

    def word(number: Column) -> Column:
        return F.concat(F.lit("w"), number.cast("string"))

    words = table.select(word(F.col("vec_id")).alias("term"), F.slice("embedding", 1, 2).alias("vec"))
    fits = ridge.ridge_fits(_planar_samples(spark, sf_dir), ["label"], ["vec_id"], best_only=True)
    labels = F.when(F.col("label") % 5 != 0, F.array(F.lit("amod"), F.lit("dobj"))).otherwise(F.array(F.lit("amod")))
    fitted = cut_lineage(fits.select(F.col("label").alias("of"), "mat"))
    owners = table.select(F.col("label").alias("of"), word(F.col("vec_id")).alias("word"), F.explode(labels).alias("label"))
    modifiers = owners.join(F.broadcast(fitted), "of").select("word", "label", "mat")  # one row for each label

    size = oracles.PLANAR_SIZE
    g, at = F.floor(F.col("vec_id") / size), (F.col("vec_id") % size).cast("int")
    free = F.when(g % 3 == 0, "pmod").otherwise("amod")
    kinds = [F.lit(None).cast("string"), free, F.lit("dobj"), F.lit("amod"), F.lit("pmod"), F.lit("amod"), F.lit("pmod")]

    def node(number: Column, parent: Column, level: Column, path: Column, label: Column, own: Column) -> Column:
        above = F.when(label != "pmod", word(g * size + parent))
        columns = {"node": number, "parent": parent, "level": level, "path": path, "label": label, "word": own, "head": above}
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    parent = F.get(F.array(*[F.lit(p).cast("int") for p in oracles.PLANAR_PARENTS]), at)
    level = F.when(at == 0, 0).when(parent == 0, 1).otherwise(2)
    path = F.when(at == 0, "").when(parent == 0, F.concat(F.lit("."), at)).otherwise(F.concat(F.lit("."), parent, F.lit("."), at))
    own = node(at, parent, level, path, F.get(F.array(*kinds), at), word(F.col("vec_id")))
    stray = node(F.lit(size), F.lit(0), F.lit(1), F.lit(".7"), free, F.lit("unknown"))
    fragments = table.select(
        F.floor(g / 4).alias("rule_id"),
        F.when(g % 2 == 0, "L").otherwise("R").alias("side"),
        (F.floor(g % 4 / 2) + 1).cast("int").alias("frag"),
        F.inline(F.when((at == 0) & (g % 11 == 5), F.array(own, stray)).otherwise(F.array(own))),
    )
    return fragments, words, cut_lineage(modifiers)


def compose_planar(spark, sf_dir):
    composed = compose.compose(*_planar_parts(spark, sf_dir))
    x, y = (F.get("vec", F.lit(i)) for i in (0, 1))
    return composed.select("rule_id", "side", "frag", "status", _round(x).alias("x"), _round(y).alias("y"))


def score_planar(spark, sf_dir):
    nodes, words, modifiers = _planar_parts(spark, sf_dir)
    fragments = cut_lineage(compose.compose(nodes, words, modifiers))
    scores = rules.rule_scores(nodes.select("rule_id").distinct(), fragments)
    rows = scores.select("rule_id", "status", "mean_sim", F.posexplode_outer("matches").alias("at", "m"))
    columns = ("m.place", "m.sim", "m.l_frag", "m.r_frag")
    return _rounded(rows.select("rule_id", "status", "mean_sim", *columns), "mean_sim", "sim")


def _placed(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return trees.phrase_sentences(standin.rule_phrases(docs), standin.rule_sentences(docs))


def rule_tokens(spark, sf_dir):
    return trees.rule_tokens(_placed(spark, sf_dir))


def dep_depth(spark, sf_dir):
    seen = trees.depths(standin.rule_sentences(_documents(spark, sf_dir)))
    placed = seen.select("rule_id", "side", "sent_no", F.posexplode("depth").alias("at", "depth"))
    return placed.select("rule_id", "side", "sent_no", (F.col("at") + 1).alias("idx"), "depth")


def phrase_highest_node(spark, sf_dir):
    return trees.highest_nodes(_placed(spark, sf_dir))


def phrase_nodes(spark, sf_dir):
    steps = F.transform("path", lambda i: F.concat(F.lit("."), F.lpad(i.cast("string"), 10, "0")))
    return trees.phrase_nodes(_placed(spark, sf_dir), together=True).select(
        "rule_id", "side", "frag", "node", "level", F.array_join(steps, "").alias("path"), "label", "word", "head"
    )


def phrase_expressions(spark, sf_dir):
    rules_table = standin.rule_phrases(_documents(spark, sf_dir))
    return trees.expression_texts(rules_table, trees.phrase_nodes(_placed(spark, sf_dir), together=True), together=True)


def expressions_read(spark, sf_dir):
    nodes = rules.nodes_from_text(phrase_expressions(spark, sf_dir))
    place = Window.partitionBy("rule_id", "side", "frag").orderBy("node")
    return nodes.select(
        "rule_id", "side", "frag", "level", "label", "word", "head",
        F.row_number().over(place).cast("bigint").alias("place"),
    )


def _embedded_fragments(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 8).alias("rule_id"),
        F.when(F.col("vec_id") % 2 == 0, "L").otherwise("R").alias("side"),
        F.floor(F.col("vec_id") % 8 / 2).cast("int").alias("frag"),
        F.col("embedding").alias("vec"),
    )


def mean_similarity(spark, sf_dir):
    return _rounded(rules.mean_similarity(_embedded_fragments(spark, sf_dir)), "mean_sim")


def greedy_match(spark, sf_dir):
    return _rounded(rules.greedy_match(_embedded_fragments(spark, sf_dir)), "sim")


def match_rounds(spark, sf_dir):
    """All vectors as the two sides of one rule; what one task may match is small, so that rounds do the work."""
    sides = _embeddings(spark, sf_dir).select(
        F.lit(0).alias("rule_id"),
        F.when(F.col("vec_id") % 2 == 0, "L").otherwise("R").alias("side"),
        F.floor(F.col("vec_id") / 2).cast("int").alias("frag"),
        F.col("embedding").alias("vec"),
    )
    return _rounded(matching.match_by_rounds(rules.usable_fragments(sides), held=64), "sim")


def _parts_of_composition(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    nodes = trees.phrase_nodes(_placed(spark, sf_dir), together=True)
    return nodes, trained.space.word_vectors, cut_lineage(trained.modifiers)


def compose_vectors(spark, sf_dir):
    fragments = compose.compose(*_parts_of_composition(spark, sf_dir), together=True)
    length = F.when(F.col("vec").isNotNull(), F.round(vectors.norm(F.col("vec")), 6))
    return fragments.select("rule_id", "side", "frag", "status", length.alias("length"))


def _scored(spark, sf_dir):
    table = standin.rule_phrases(_documents(spark, sf_dir))
    parts = compose.composed(*_parts_of_composition(spark, sf_dir), together=True)
    return rules.rule_scores(table, [(part if together else cut_lineage(part), together) for part, together in parts])


def matched_planar(spark, sf_dir):
    """The matched fragments of ``score_planar`` with their expressions and vectors."""
    nodes, words, modifiers = _planar_parts(spark, sf_dir)
    fragments = cut_lineage(compose.compose(nodes, words, modifiers))
    scores = rules.rule_scores(nodes.select("rule_id").distinct(), fragments)
    texts = nodes.where("node = 0").select("rule_id", "side", "frag", F.col("word").alias("expr"))
    rows = rules.matched_vectors(scores, texts, fragments)
    x, y = (F.get("vec", F.lit(i)) for i in (0, 1))
    return rows.select("rule_id", "place", "side", "expr", _round(x).alias("x"), _round(y).alias("y"))


def rule_status(spark, sf_dir):
    count = F.coalesce(F.size("matches"), F.lit(0)).cast("bigint")
    n_matches = F.when(F.col("matches").isNull(), F.lit(0).cast("bigint")).otherwise(count)
    return _scored(spark, sf_dir).select("rule_id", "status", n_matches.alias("n_matches"))


def rule_scores(spark, sf_dir):
    rows = _scored(spark, sf_dir).select(
        "rule_id", "status", "mean_sim", F.posexplode_outer("matches").alias("at", "m")
    )
    return _rounded(
        rows.select("rule_id", "status", "mean_sim", "m.place", "m.sim", "m.l_frag", "m.r_frag"),
        "mean_sim",
        "sim",
    )


def counts_reloaded(spark, sf_dir):
    lines = text_formats.format_counts(word_counts(spark, sf_dir))
    return vocab.frequency_vocab(text_formats.parse_counts(lines), VOCAB)


def _in_parts(spark, sf_dir, n: int = 3) -> list[DataFrame]:
    """The parsed corpus as parts that arrive one after the other; every line is in one of them."""
    parsed = cut_lineage(_parsed(spark, sf_dir))
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
    return [parsed.where(part == i) for i in range(n)]


def _buckets(spark, sf_dir) -> int:
    """Buckets for the counts of a corpus: more of them for a larger one, so that none grows with it."""
    size = corpus.stored_bytes(spark, f"{sf_dir}/documents.parquet")
    return min(max(store.BUCKETS, size // corpus.DEALT_BYTES), store.MOST_BUCKETS)


def _merged(parts: list[DataFrame], count: Callable, keys: list[str], value: str, buckets: int) -> DataFrame:
    saved = store.save(count(parts[0]), keys, buckets)
    for part in parts[1:]:
        saved = store.merge_counts(saved, count(part), keys, value, buckets)
    return saved


def counts_merged(spark, sf_dir):
    return _merged(_in_parts(spark, sf_dir), vocab.tagged_word_counts, ["term"], "cnt", _buckets(spark, sf_dir))


def pairs_merged(spark, sf_dir):
    return _merged(_in_parts(spark, sf_dir), cooc.tagged_pair_counts, ["a", "b"], "n", _buckets(spark, sf_dir))


def matrix_columns(spark, sf_dir):
    """Entries and norm of every column, and the column of the product with the vector of all norms."""
    stored = store.save(coo_binary(spark, sf_dir), ["col"])
    columns = cut_lineage(store.columns(stored))
    times = store.product(stored, columns.select("col", F.col("norm").alias("x")))
    joined = columns.join(times.select(F.col("row").alias("col"), F.col("val").alias("times")), "col", "left")
    return _rounded(joined, "norm", "times")


def triplets_reloaded(spark, sf_dir):
    lines = text_formats.format_triplets(_tagged(spark, sf_dir).ppmi())
    return matrix.load_matrix(text_formats.parse_triplets(lines))


def matrix_ppmi(spark, sf_dir):
    return _rounded(matrix.load_matrix(_tagged(spark, sf_dir).ppmi(), "ppmi"), "val")


def training_list(spark, sf_dir):
    built = build_phrases(_tagged(spark, sf_dir), min_count=5)
    listed = ridge.training_list(built.vocab, 3)
    lines = listed.select("label", F.concat("word", F.lit("\t"), "label").alias("value"))
    return lines.select("label", text_formats.first_field(F.col("value")).alias("word"))


def rule_table(spark, sf_dir):
    """Tab-separated rule lines built from the documents, read back by position."""
    sides = standin.rule_phrases(_documents(spark, sf_dir))
    both = sides.groupBy("rule_id").pivot("side", ["L", "R"]).agg(F.first("phrase"))
    name = F.concat(F.lit("["), F.col("rule_id").cast("string"), F.lit("]"))
    blank = [F.lit("")] * 6
    line = F.concat_ws("\t", name, "L", "R", *blank, F.upper("L"), F.upper("R"))
    fields = both.select("rule_id", F.split(line, "\t").alias("f"))
    read = text_formats.rule_columns(fields)
    places = trees.phrase_indices(read.where(F.col("phrase") != ""))
    counted = places.select("rule_id", "side", F.posexplode("places").alias("ord", "place"))
    return counted.join(read.select("rule_id", "side", "rule"), ["rule_id", "side"])


def entry(spark: SparkSession) -> DataFrame:
    """Plain word PPMI over the documents, strongest pairs first."""
    job = plain_words(_lines(spark, "/root/testdata/sf0.001"))
    return _rounded(job.ppmi(), "val").orderBy(F.desc("val"), "min_idx", "max_idx")


QUERIES: tuple[Query, ...] = (
    tokens_plain,
    tokens_tagged,
    deps_decoded,
    word_counts,
    corpus_totals,
    vocab_lex_index,
    vocab_freq_topk,
    pairs_plain,
    pairs_tagged,
    ppmi_plain,
    ppmi_words,
    phrase_instances,
    phrase_counts,
    phrase_vocab_index,
    phrase_contexts,
    ppmi_phrases,
    sparse_vectors,
    coo_binary,
    coo_symmetric,
    matrix_stats,
    word_cosine,
    dense_cosine,
    normalise_vectors,
    randomized_svd,
    randomized_eigen,
    randomized_pca,
    svd_rank_cut,
    word_vectors,
    phrase_vectors,
    train_samples,
    ridge_modifiers,
    gcv_lambda,
    ridge_full,
    train_modifiers,
    rule_tokens,
    dep_depth,
    phrase_highest_node,
    phrase_nodes,
    phrase_expressions,
    expressions_read,
    mean_similarity,
    greedy_match,
    match_rounds,
    compose_vectors,
    rule_status,
    rule_scores,
    compose_planar,
    score_planar,
    matched_planar,
    counts_reloaded,
    counts_merged,
    pairs_merged,
    matrix_columns,
    triplets_reloaded,
    matrix_ppmi,
    training_list,
    rule_table,
    parsed_dropped,
    pairs_plain_filtered,
    rule_tokens_by_range,
)


def _training_data():
    """The module of the training-data queries, or None where that subpackage is not installed."""
    try:
        import corpus_pipeline
        from lexweave.llm import queries as llm_queries
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "lexweave.llm", "lexweave.llm.queries"):
            raise
        return None
    return llm_queries, corpus_pipeline


def queries() -> dict[str, Query]:
    found = {q.__name__: q for q in QUERIES}
    if parts := _training_data():
        found |= {q.__name__: q for q in parts[0].QUERIES} | {"pipeline": parts[1].run}
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(oracles.ORACLES)
    if parts := _training_data():
        found |= parts[0].ORACLES
        if parts[1].ORACLE_SQL:
            found["pipeline"] = parts[1].ORACLE_SQL
    return found
