"""Nested JSON records to typed rows, citations, frozen inventories, seals and replayed calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.checks import key_differences, repeated_keys, require
from cairn.operators.identity import digest_tree
from cairn.operators.joins import first_reason

HEX64 = "^[0-9a-f]{64}$"


def decoded(df: DataFrame, text: str, schema: str, items: str, rules: list[tuple[str, str]], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the items, one row with reason for each record that is turned down): a record counts in full or not at all.

    text holds one JSON object of the given schema with an array column items. rules are (reason, SQL condition on
    the column item); the first rule that any item breaks, in the order of the rules, turns its record down, as
    does JSON that is not of the schema ("shape"). A condition that is null is broken.
    """
    judged = judged_items(df, text, schema, items, rules, keep)
    record = F.struct(*keep)
    worst = judged.groupBy(record.alias("__record")).agg(F.min("__rule").alias("__rule"))
    names = F.array(F.lit("shape"), *[F.lit(name) for name, _ in rules])
    down = worst.where("__rule is not null").select("__record.*", F.element_at(names, F.col("__rule") + 1).alias("reason"))
    good = worst.where("__rule is null").select(F.col("__record").alias("__good"))
    rows = judged.where("item is not null").join(good, F.equal_null(record, F.col("__good")), "left_semi").select(*keep, "item.*")
    return rows, down


def judged_items(df: DataFrame, text: str, schema: str, items: str, rules: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """(keep, item, __rule): each item with the number of the first rule that it breaks; a malformed record has one row and rule 0."""
    parsed = df.select(*keep, F.from_json(text, schema).alias("__parsed"))
    listed = F.col(f"__parsed.{items}")
    each = parsed.select(*keep, listed.isNull().alias("__bad"), F.explode_outer(listed).alias("item"))
    broken = F.when(F.col("__bad"), 0)
    for number, (_, condition) in enumerate(rules, 1):
        broken = broken.when(F.col("item").isNotNull() & ~F.coalesce(F.expr(condition), F.lit(False)), number)
    return each.select(*keep, "item", broken.alias("__rule"))


def isolated(df: DataFrame, text: str, schema: str, items: str, rules: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """(keep, item columns, error): every item, a malformed one as a row with its error in place of its values."""
    judged = judged_items(df, text, schema, items, rules, keep)
    names = F.array(F.lit("shape"), *[F.lit(name) for name, _ in rules])
    error = F.when(F.col("__rule").isNotNull(), F.element_at(names, F.col("__rule") + 1))
    return judged.where("item is not null or __rule is not null").select(*keep, F.when(F.col("__rule").isNull(), F.col("item")).alias("item"), error.alias("error")).select(*keep, "item.*", "error")


def record_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 32 digits of the sha256 of the parts, NUL between them."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256), 1, 32))


def citation_faults(cited: DataFrame, supplied: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Cited spans that were not supplied or were supplied with another digest, with reason."""
    own = supplied.select(*keys, F.col(digest).alias("__own")).distinct()
    # a span may be supplied with several digests: one that agrees is enough
    met = cited.join(own, keys, "left").groupBy(*keys, digest).agg(F.count("__own").alias("__n"), F.coalesce(F.bool_or(F.col("__own") == F.col(digest)), F.lit(False)).alias("__same"))
    reason = F.when(F.col("__n") == 0, "not_supplied").when(~F.col("__same"), "changed")
    return met.select(*keys, digest, reason.alias("reason")).where("reason is not null")


def edge_faults(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges (src, dst) with an end that is no allowed node."""
    allowed = nodes.select(F.col(node).alias("__n")).distinct()
    bad = lambda end: edges.join(allowed, F.col(end) == F.col("__n"), "left_anti")
    return bad("src").unionByName(bad("dst")).distinct()


def tree_digest(files: DataFrame, tree: list[str], path: str, content: str) -> DataFrame:
    """(tree, files, digest): one identity of each tree of files.

    A file's digest is that of its path, NUL and the sha256 of its content; digest_tree() gathers them, so the result
    depends on neither order nor partitioning, and is not the digest of all bytes in one stream.
    """
    each = files.select(*tree, F.sha2(F.concat_ws("\x00", F.col(path).cast("string"), F.sha2(F.col(content), 256)), 256).alias("__d"))
    return digest_tree(each, tree, "digest", "files")


def rows_digest(df: DataFrame, key: str) -> DataFrame:
    """(rows, digest) of a table with a key: one row."""
    body = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in sorted(df.columns)])
    return tree_digest(df.select(F.lit(1).alias("__t"), F.col(key).alias("__p"), body.alias("__c")), ["__t"], "__p", "__c").select(F.col("files").alias("rows"), "digest")


def seal(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, rows, digest, seal_id): the digest of each named table by its key, and one identity of them all.

    It says what the contents are, not when or by whom they were written.
    """
    each = None
    for name, (df, key) in sorted(tables.items()):
        one = rows_digest(df, key).select(F.lit(name).alias("name"), "rows", "digest")
        each = one if each is None else each.unionByName(one)
    # one row for each table
    whole = each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat_ws("=", x["name"], x["digest"])), ","), 256).alias("seal_id"))
    return each.crossJoin(F.broadcast(whole))


def frozen(rows: DataFrame, key: str, digests: list[str]) -> DataFrame:
    """rows as an inventory without labels: keys must be there once, digests be null or 64 hexadecimal digits."""
    require(rows.where(F.col(key).isNull()), "row without a key")
    require(repeated_keys(rows, [key]), "repeated key")
    bad = first_reason([(~F.col(c).rlike(HEX64), c) for c in digests])
    require(rows.where(bad.isNotNull()), "malformed digest")
    return rows.withColumn("behavior_label", F.lit(None).cast("string"))


def bound(inventory: DataFrame, labels: DataFrame, key: str, label: str, domain: list[str]) -> DataFrame:
    """A frozen inventory with its labels: each key has one, of the domain, and none is bound yet."""
    require(inventory.where("behavior_label is not null"), "labels are bound already")
    require(repeated_keys(labels, [key]), "repeated label")
    require(key_differences(inventory, labels, [key]), "labels and inventory differ")
    require(labels.where(~F.coalesce(F.col(label).isin(domain), F.lit(False))), "label outside its domain")
    return inventory.drop("behavior_label").join(labels.select(key, F.col(label).alias("behavior_label")), key)


def label_free(census: DataFrame, columns: list[str], label: str, state: str) -> DataFrame:
    """A queue of the census: the given columns, no label and an unverified state; a census that shows a label is refused."""
    require(census.where(F.col(label).isNotNull() | ~F.equal_null(F.col(state), F.lit("unverified"))), "label leak")
    return census.select(*columns, F.lit("unverified").alias("runtime_state"), F.lit(None).cast("string").alias("behavior_label"))


def replayed(requests: DataFrame, recorded: DataFrame, body: str) -> DataFrame:
    """requests with the recorded response of the same sha256 of the body, and status: replayed, missing, changed (a
    response that is not of its recorded digest) or ambiguous (several recordings). recorded has request_sha256, response, response_sha256."""
    asked = requests.withColumn("request_sha256", F.sha2(body, 256))
    own = recorded.groupBy("request_sha256").agg(F.count("*").alias("__n"), F.first("response").alias("response"), F.first("response_sha256").alias("__sha"))
    found = asked.join(own, "request_sha256", "left")
    status = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").when(~F.equal_null(F.sha2("response", 256), F.col("__sha")), "changed").otherwise("replayed")
    return found.withColumn("status", status).withColumn("response", F.when(F.col("status") == "replayed", F.col("response"))).drop("__n", "__sha")


def first_products(sides: list[DataFrame], order: list[str], k: int) -> DataFrame:
    """The first k rows, in a full order, of the product of small dimension tables. Only each side's first k rows in that order can take part."""
    out = None
    for side in sides:
        own = [c for c in order if c in side.columns]
        some = side.distinct().orderBy(*own).limit(k)
        out = some if out is None else out.crossJoin(F.broadcast(some))
    return out.orderBy(*order).limit(k)
