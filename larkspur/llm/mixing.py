"""Mixing sources to target weights: iterative proportional fitting over (source, language, topic) cells. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.names import col, others, quoted, unused
from larkspur.llm.quality_rules import words
from larkspur.llm.storage import drop_table, table_bytes, write_table

DIMENSIONS = ("source", "lang", "topic")
#: Cells (not documents) that may be raked in one row.
FEW_CELLS = 4096
#: Strings that tell a topic, the first that a text (in lower case) has; then a digit; then prose.
MARKERS = (("legal", ("license", "copyright", "warranty")), ("contact", ("@",)), ("table", (" | ",)), ("noise", ("%%%", "$$$", "***", "&&&", "###")))


def topic_of(text: Column) -> Column:
    """What a text is about as far as its surface tells: legal, contact, table, noise (by MARKERS), numeric (a digit) or prose. Null: prose. Tables with topics of their own bring them as a column."""
    low, out = F.lower(text), None
    for name, marks in MARKERS:
        has = F.contains(low, F.lit(marks[0]))
        for m in marks[1:]:
            has = has | F.contains(low, F.lit(m))
        out = F.when(has, name) if out is None else out.when(has, name)
    return out.when(text.rlike("[0-9]"), "numeric").otherwise("prose")


def token_cells(df: DataFrame, text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Tokens (words) by cell. Null dimensions count as ''."""
    return df.groupBy(*[F.coalesce(col(d).cast("string"), F.lit("")).alias(d) for d in dimensions]).agg(F.sum(F.size(words(col(text_col)))).cast("double").alias("tokens"))


def tempered_shares(cells: DataFrame, dimension: str, power: float = 0.5) -> DataFrame:
    """Target shares (value, share) in proportion to tokens^power: large values give way to small ones."""
    by = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("mass"))
    total = by.agg(F.sum("mass").alias("all_mass"))
    return by.select("value", (F.col("mass") / F.nullif(total.scalar(), F.lit(0.0))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, tolerance: float = 1e-9, rounds: int = 100, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """cells with weight: tokens, scaled again and again until each dimension's sums are its target shares of all tokens.

    Ends when no cell's weight has moved by more than `tolerance` of itself in a round, or after `rounds` (targets that no weights meet).
    targets: per dimension a table (value, share); a value without a share gets weight 0. Each step sums the cells by one
    dimension (partial sums before the shuffle) and joins the factors back. Cells and factors are distributed
    tables, written to the shared folder after each round, so plans stay short whatever the number of rounds.
    """
    total = cells.agg(F.sum("tokens")).scalar()
    targets = {d: write_table(t.select("value", (F.col("share") * total).alias("target")), "target") for d, t in targets.items()}
    at = write_table(cells.withColumn("weight", F.col("tokens")), "cells")
    # A dimension has no more values than there are cells: the size of the cells bounds that of the factors.
    small = table_bytes(at) <= broadcast_bytes
    for _ in range(rounds):
        step = at.withColumn("moved", F.lit(0.0))
        for d, target in targets.items():
            sums = step.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("sum"))
            factors = sums.join(target, "value", "left").select(F.col("value").alias(d), F.when(F.col("sum") > 0, F.coalesce("target", F.lit(0.0)) / F.col("sum")).otherwise(F.lit(0.0)).alias("factor"))
            step = step.join(F.broadcast(factors) if small else factors, d)
            step = step.withColumn("moved", F.when(F.col("weight") > 0, F.greatest("moved", F.abs(F.col("factor") - 1))).otherwise(F.lit(0.0))).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        before, at = at, write_table(step, "cells")
        drop_table(before)
        moved = at.agg(F.max("moved")).first()[0]
        at, path = at.drop("moved"), at._larkspur_path
        at._larkspur_path = path
        if moved is None or moved <= tolerance:
            break
    for t in targets.values():
        drop_table(t)
    return at


def rake_few(cells: DataFrame, targets: dict[str, DataFrame], *, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """What rake returns, of few cells, none of whose dimensions is null: all rounds are folds over arrays in one row, so there is one plan, and no job for each round."""
    names = cells.columns
    row = cells.agg(F.array_sort(F.collect_list(F.struct(*targets, *[c for c in names if c not in targets]))).alias("cells"), F.sum("tokens").alias("total"))
    for k, (d, t) in enumerate(targets.items()):
        of = t.where("value is not null and share is not null").agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias(f"share{k}"))
        row = row.crossJoin(F.broadcast(of)).withColumn(f"values{k}", F.array_sort(F.array_distinct(F.col("cells")[d])))
        row = row.withColumn(f"at{k}", F.transform(F.col("cells")[d], lambda v: (F.array_position(f"values{k}", v) - 1).cast("int")))
        members = F.transform(f"values{k}", lambda _, i: F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda j: F.col(f"at{k}")[j] == i))
        wanted = F.transform(f"values{k}", lambda v: F.coalesce(F.element_at(f"share{k}", v) * F.col("total"), F.lit(0.0)))
        row = row.withColumn(f"d{k}", F.struct(F.col(f"at{k}").alias("at"), members.alias("members"), wanted.alias("target")))

    def scaled(state: Column, d: Column) -> Column:
        """state (w, moved: of each cell), each weight times its value's target over the value's sum."""
        sums = F.transform(d["members"], lambda m: F.aggregate(m, F.lit(0.0), lambda s, j: s + F.coalesce(state["w"][j], F.lit(0.0))))
        factors = F.zip_with(sums, d["target"], lambda s, t: F.when(s > 0, t / s).otherwise(F.lit(0.0)))
        # An array of one element, transformed, is a name for it: factors are made once.
        moved = lambda f: F.transform(d["at"], lambda v, i: F.when(state["w"][i] > 0, F.greatest(state["moved"][i], F.abs(f[v] - 1))).otherwise(F.lit(0.0)))
        return F.transform(F.array(factors), lambda f: F.struct(F.transform(d["at"], lambda v, i: state["w"][i] * f[v]).alias("w"), moved(f).alias("moved")))[0]

    fresh = lambda s, far: F.struct(s["w"].alias("w"), F.transform(s["w"], lambda _: F.lit(far)).alias("moved"))
    around = lambda s: F.aggregate(F.array(*[F.col(f"d{k}") for k in range(len(targets))]), fresh(s, 0.0), scaled)
    weights = F.transform(F.col("cells")["tokens"], lambda x: x.cast("double"))
    start = fresh(F.struct(weights.alias("w")), float("inf"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(F.array_max(s["moved"]) <= tolerance, s).otherwise(around(s))) if rounds > 0 else start
    # One element here too, so that the fold runs once, not for each cell.
    made = F.transform(F.array(end), lambda s: F.transform("cells", lambda c, i: F.struct(*[c[n].alias(n) for n in names], s["w"][i].alias("weight"))))[0]
    return row.select(F.explode_outer(made).alias("c")).where("c is not null").select("c.*")


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of key and salt."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.8, salt: str = ":mix", tolerance: float = 1e-9, rounds: int = 100, power: float = 0.5, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """df (with the dimensions as columns) with n_tokens, weight, probability, copies and sampled added (they replace columns of these names, in any case).

    weight: raked over tokens of the document's cell, 1 on average over all tokens. copies: how often the document goes into the mix, keep * weight on
    average, so that the mix has the shares it was raked to: the whole part of that, and one more with the probability of the rest, if
    a hash of the id is below it. So the draw is the same on every run, and repeated rows share it. probability: that the document is in the mix at all, min(1, keep * weight);
    sampled: whether it is. Up to FEW_CELLS cells, whatever the number of documents, are raked by one job, more by a job a round. Null and empty texts have no
    tokens; in a cell without any tokens weight, probability and copies are 0. The cells' weights are broadcast if their table is
    under broadcast_bytes, else joined by a shuffle whose skewed partitions adaptive execution splits.
    """
    dims = DIMENSIONS
    new = ["n_tokens", "weight", "probability", "copies", "sampled"]
    names = others(df.columns, new)
    of = unused([*names, *new], *dims)
    cells = write_table(token_cells(df, text_col), "token-cells")
    targets = {d: tempered_shares(cells, d, power) for d in dims}
    few = table_bytes(cells) <= broadcast_bytes and cells.count() <= FEW_CELLS
    raked = write_table(rake_few(cells, targets, tolerance=tolerance, rounds=rounds), "cells") if few else rake(cells, targets, tolerance=tolerance, rounds=rounds, broadcast_bytes=broadcast_bytes)
    ratio = write_table(raked.select(*[F.col(d).alias(x) for d, x in zip(dims, of, strict=True)], F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)).alias("weight")), "cell-weights")
    drop_table(raked)
    drop_table(cells)
    ratio = F.broadcast(ratio) if table_bytes(ratio) <= broadcast_bytes else ratio
    on = [F.coalesce(col(d).cast("string"), F.lit("")) == col(x) for d, x in zip(dims, of, strict=True)]
    joined = df.select(*map(quoted, names)).join(ratio, on, "left")
    out = joined.select(*map(quoted, names), F.size(words(col(text_col))).cast("long").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    out = out.withColumn("probability", F.least(F.lit(1.0), F.lit(keep) * F.col("weight")))
    draw, times = uniform(col(id_col), salt), F.lit(keep) * F.col("weight")
    return out.withColumn("copies", F.floor(times) + (draw < times - F.floor(times)).cast("long")).withColumn("sampled", F.col("copies") > 0)


def marginals(mixed: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, value, raw, target, mixed): shares of the tokens by each dimension of what mix returned: of all documents, as raked, and of the mix."""
    name, value = unused(mixed.columns, "dimension", "value")
    every = F.explode(F.array(*[F.struct(F.lit(d).alias(name), F.coalesce(col(d).cast("string"), F.lit("")).alias(value)) for d in dimensions])).alias("x")
    by = mixed.select(every, "n_tokens", "weight", "copies").groupBy("x").agg(F.sum("n_tokens").alias("raw"), F.sum(F.col("n_tokens") * F.col("weight")).alias("target"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"))
    total = mixed.agg(*[F.sum(c).alias(n) for c, n in ((F.col("n_tokens"), "all_raw"), (F.col("n_tokens") * F.col("weight"), "all_target"), (F.col("n_tokens") * F.col("copies"), "all_mixed"))])
    share = lambda n: (F.col(n) / F.nullif(F.col(f"all_{n}"), F.lit(0))).alias(n)
    return by.crossJoin(F.broadcast(total)).select(F.col(f"x.{name}").alias("dimension"), F.col(f"x.{value}").alias("value"), share("raw"), share("target"), share("mixed"))
