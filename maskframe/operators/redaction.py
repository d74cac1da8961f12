"""From resolved spans to items, summaries and redacted text; all columns of one row, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions.kernel import code_points, cut, let, sweep
from maskframe.functions.registry import MODES, REDACTED, all_categories, lookup, pseudonym_key

ITEM = "array<struct<id:string,category:string,text:string,start:int,end:int,replacement:string,kept:boolean>>"


def match_id(span: Column, page: Column | None = None, source: str = "text") -> Column:
    where = F.lit("t") if page is None else F.coalesce(page.cast("string"), F.lit("t"))
    return F.concat_ws(":", where, F.lit(source), span["category"], span["start"].cast("string"), span["end"].cast("string"))


def replacements(matches: Column, mode: str = "redacted") -> Column:
    """The replacement of each match; pseudonyms number a category's different values by first appearance."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "redacted":
        return F.transform(matches, lambda x: F.lit(REDACTED))
    if mode == "label":
        return F.transform(matches, lambda x: F.concat(F.lit("["), lookup(x["category"], "label"), F.lit("]")))
    return let(matches, _pseudonyms)


def _pseudonyms(matches: Column) -> Column:
    """Tokens of the matches; a value is numbered among its category's by where it first appears.

    Sorted by value, every match learns the place of its value's first one; in order of place, first ones are counted
    by category, and the others take the number from the place they know.
    """
    names = all_categories()
    number_of = F.create_map(*(F.lit(x) for i, c in enumerate(names) for x in (c, i)))
    keyed = F.transform(matches, lambda x, i: F.struct(F.concat(x["category"], F.lit("\0"), pseudonym_key(x["category"], x["text"])).alias("key"), i.alias("i")))

    def learn(acc: Column, x: Column) -> tuple[dict[str, Column], None, Column]:
        first = F.when(acc["key"].eqNullSafe(x["key"]), acc["first"]).otherwise(x["i"])
        return {"key": x["key"], "first": first}, None, F.array(F.struct(x["i"].alias("i"), first.alias("first")))

    learnt = sweep(F.array_sort(keyed), {"key": F.lit(None).cast("string"), "first": F.lit(-1)}, learn, "array<struct<i:int,first:int>>")["out"]
    placed = F.transform(F.arrays_zip(F.array_sort(learnt).alias("l"), matches.alias("m")), lambda x: F.struct(x["l"]["i"].alias("i"), x["l"]["first"].alias("first"), F.element_at(number_of, x["m"]["category"]).alias("c")))

    def count(acc: Column, x: Column) -> tuple[dict[str, Column], None, Column]:
        new = x["i"] == x["first"]
        counts = F.when(new, F.transform(acc["counts"], lambda n, c: F.when(c == x["c"], n + 1).otherwise(n))).otherwise(acc["counts"])
        return {"counts": counts}, None, F.array(F.when(new, F.element_at(acc["counts"], x["c"] + 1) + 1).otherwise(0))

    numbers = lambda at: sweep(at, {"counts": F.array_repeat(F.lit(0), len(names))}, count, "array<int>")["out"]
    token = lambda at: let(numbers(at), lambda ns: F.transform(F.arrays_zip(at.alias("p"), matches.alias("m")), lambda x: F.concat(F.lit("["), lookup(x["m"]["category"], "prefix"), F.lit("_"), F.element_at(ns, x["p"]["first"] + 1).cast("string"), F.lit("]"))))
    return let(placed, token)


def items(matches: Column, mode: str = "redacted", excluded: Column | None = None, page: Column | None = None, source: str = "text") -> Column:
    """Matches with ids and replacements. Excluded ids are flagged as kept; tokens are given before exclusion, so
    keeping one value doesn't renumber the others."""
    tokens = replacements(matches, mode)

    def one(pair: Column) -> Column:
        m = pair["m"]
        name = match_id(m, page, source)
        kept = F.lit(False) if excluded is None else F.coalesce(F.array_contains(excluded, name), F.lit(False))
        return F.struct(name.alias("id"), m["category"].alias("category"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), pair["r"].alias("replacement"), kept.alias("kept"))

    return F.transform(F.arrays_zip(matches.alias("m"), tokens.alias("r")), one)


def exclude(listed: Column) -> Column:
    """Items without those that are kept as they are."""
    return F.filter(listed, lambda x: ~x["kept"])


def summary(listed: Column) -> Column:
    """struct(counts, total, items): counts has every category, and leaves out kept items, as total does."""
    names = F.array(*(F.lit(c) for c in all_categories()))
    cut_out = lambda listed: F.transform(exclude(listed), lambda x: x["category"])
    counted = lambda cs: F.struct(F.map_from_arrays(names, F.transform(names, lambda c: F.size(cs) - F.size(F.array_remove(cs, c)))).alias("counts"), F.size(cs).alias("total"))
    return let(cut_out(listed), counted).withField("items", listed)


def empty_summary() -> Column:
    return summary(F.array().cast(ITEM))


def render(text: Column, listed: Column) -> Column:
    """The text with every item's replacement in its place, kept items left alone."""

    def filled(cuts: Column, codes: Column) -> Column:
        end = lambda i: F.when(i > 0, F.element_at(cuts, F.greatest(i, F.lit(1)))["end"]).otherwise(0)
        filled_in = F.transform(cuts, lambda x, i: F.concat(cut(codes, end(i), x["start"] - end(i)), x["replacement"]))
        return F.concat(F.array_join(filled_in, ""), cut(codes, end(F.size(cuts)), F.length(text)))

    done = let(exclude(listed), lambda cuts: F.when(F.size(cuts) > 0, let(code_points(text), lambda codes: filled(cuts, codes))).otherwise(text))
    return F.when(text.isNotNull(), done)


def segments(text: Column, listed: Column) -> Column:
    """Plain and matched runs that make up the text; items out of range or over an earlier one are left out."""
    usable = F.filter(listed, lambda x: (x["start"] < x["end"]) & (x["end"] <= F.length(text)))
    order = F.transform(usable, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x["end"].alias("e"), x["id"].alias("id")))
    kind = "array<struct<start:int,end:int,text:string,item:string>>"

    def run(codes: Column) -> Column:
        piece = lambda s, e, item: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), cut(codes, s, e - s).alias("text"), item.cast("string").alias("item"))

        def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
            plain = F.when(x["s"] > acc["cursor"], F.array(piece(acc["cursor"], x["s"], F.lit(None)))).otherwise(F.array().cast(kind))
            fits = x["s"] >= acc["cursor"]
            return {"cursor": F.when(fits, x["e"]).otherwise(acc["cursor"])}, fits, F.concat(plain, F.array(piece(x["s"], x["e"], x["id"])))

        tail = lambda a: F.when(a["cursor"] < F.length(text), F.concat(a["out"], F.array(piece(a["cursor"], F.length(text), F.lit(None))))).otherwise(a["out"])
        return let(sweep(F.array_sort(order), {"cursor": F.lit(0)}, step, kind), tail)

    return let(code_points(text), run)


def grouped_items(listed: Column) -> Column:
    """Items by category, categories in display order and without empty ones."""
    by = F.transform(F.array(*(F.lit(c) for c in all_categories())), lambda c: F.struct(c.alias("category"), F.filter(listed, lambda x: x["category"] == c).alias("items")))
    return F.filter(by, lambda g: F.size(g["items"]) > 0)


def count_occurrences(text: Column, needle: Column) -> Column:
    """How often a substring occurs, without overlaps and as written."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def document_tokens(spans: DataFrame, document: str = "doc_id", order: tuple[str, ...] = ("page", "start")) -> DataFrame:
    """A span table (document, category, text, and the order columns) with ``token``, the document-wide pseudonym.

    A category's values are numbered by where they first appear in the document, across all its rows.
    """
    keyed = spans.withColumn("_key", pseudonym_key(F.col("category"), F.col("text")))
    first = keyed.withColumn("_first", F.min(F.struct(*order)).over(Window.partitionBy(document, "category", "_key")))
    number = F.dense_rank().over(Window.partitionBy(document, "category").orderBy("_first", "_key"))
    return first.withColumn("token", F.concat(F.lit("["), lookup(F.col("category"), "prefix"), F.lit("_"), number.cast("string"), F.lit("]"))).drop("_key", "_first")


def exclude_spans(spans: DataFrame, excluded: DataFrame, document: str = "doc_id") -> DataFrame:
    """A span table without the rows whose (document, id) is in ``excluded``."""
    return spans.join(excluded.select(document, "id"), [document, "id"], "left_anti")


def merge_summaries(parts: DataFrame, document: str = "doc_id", part: str = "page") -> DataFrame:
    """One summary per document from the ``summary`` of its parts: counts add up, items follow the parts' order.

    Counts are summed by document and category, so no row of items is held up for them.
    """
    counts = parts.select(document, F.explode("summary.counts").alias("category", "n")).groupBy(document, "category").agg(F.sum("n").cast("int").alias("n"))
    merged = counts.groupBy(document).agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("counts"), F.sum("n").cast("int").alias("total"))
    listed = parts.groupBy(document).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col("summary.items").alias("i")))), lambda x: x["i"])).alias("items"))
    return merged.join(listed, document).select(document, F.struct("counts", "total", "items").alias("summary"))


def novel_spans(found: DataFrame, reported: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Rows of ``found`` whose category and normalised text aren't among the ``reported`` ones of the same page."""
    norm = lambda df: df.withColumn("_value", pseudonym_key(F.lit("person"), F.col("text")))
    return norm(found).join(norm(reported).select(*keys, "category", "_value").distinct(), [*keys, "category", "_value"], "left_anti").drop("_value")
