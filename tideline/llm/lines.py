"""Line dedup with a log-template tree: lines whose template recurs across documents are dropped.

A line is parsed at a fixed depth: its leaf is its number of tokens and its first ``DEPTH`` tokens. Tokens that hold a
digit, an address or a link are variable and count as ``<*>`` everywhere, so a template is the masked line. A leaf may
hold many templates with further variable tokens. A token that fewer than ``min_docs`` texts of the leaf have at its place is
left out of a line; the line then stands in the group of its other tokens, and in the groups that arise when
one or two more places are left out, so names that are frequent by themselves are found too. Only the places behind the
leading tokens count: at least ``SIMILAR`` of them must stay, so none is left out of a line with up to three of them. Lines
with more than ``PAIRS`` such places don't try all pairs of places but find those that can make a group recur (``pairs_of_places``),
with the same result. A line in several such groups counts in that with most texts, and of equal ones in that with the fewest
places left out. A template or group recurs when
``min_docs`` different texts hold a line of it, and its lines go but for the first one of the row with the least id (missing
last): near copies of a document make its lines recur, and so its text stays in one of them. Copies of one text count once, so
that a document isn't emptied by its own copies. Rows equal in id and text keep that line each.

Lines end at ``\\n``. Lines without a token are kept. Null texts stay null, empty ones empty. Rows with the same id and
text get the same result each, rows with the same id and other texts are treated apart; rows without an id likewise.
Only built-in functions are used, and texts never pass a grouping: lines travel as hashes and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import join_counted, store

#: Leading tokens that make a leaf, besides the number of tokens.
DEPTH = 4
#: Share of the places behind the leading tokens that the lines of a group have in common.
SIMILAR = 0.75
#: Places behind the leading tokens up to which all pairs of places are tried; the groups are the same either way.
PAIRS = 64
#: Open places of a set that are paired without further halving.
FEW = 8
#: Leaves or templates that go to every executor with another look at the lines: 16 bytes each.
BROADCAST = 500_000


def lines_of(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def masked(line: Column) -> Column:
    """A line with single blanks between its tokens, variable tokens as <*>."""
    odd = line.contains("  ")
    for c in "\t\r\x0b\f":
        odd = odd | line.contains(c)
    single = F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\x0B\f]+", " ")).otherwise(line))
    token = r"(?<![^ ])[^ ]*(\d|@|://|www\.)[^ ]*"  # tried at the first character of a token only
    variable = single.rlike("[0-9@]") | single.contains("://") | single.contains("www.")
    return F.when(variable, F.regexp_replace(single, token, "<*>")).otherwise(single)


def parsed(docs: DataFrame) -> DataFrame:
    """A row per line with a token, from ``doc`` (a row's hash), ``id`` and ``text``: ``body`` (the text's hash), ``place``, ``line``
    (masked), ``size`` (tokens), ``template`` and ``leaf``."""
    rows = (
        docs.where(F.col("text").isNotNull())
        .select("doc", "id", F.xxhash64("text").alias("body"), F.posexplode(lines_of("text")).alias("place", "line"))
        .where(F.col("line").rlike(r"[^ \t\r\x0B\f]"))
        .select("doc", "id", "body", "place", masked(F.col("line")).alias("line"))
    )
    size = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return rows.select("*", size.alias("size"), F.xxhash64("line").alias("template")).select(
        "*", F.xxhash64("size", F.substring_index("line", " ", DEPTH)).alias("leaf")
    )


def recurring(lines: DataFrame, docs: DataFrame, min_docs: int) -> DataFrame:
    """``template``, ``group`` and ``lines`` (rows that hold it) of the templates that recur by themselves or in their largest group; ``lines`` without the lines themselves."""
    counted = (
        lines.groupBy("template", "body").agg(F.count(F.lit(1)).alias("lines"), F.min("leaf").alias("leaf"), F.min("size").alias("size"))
        .groupBy("template").agg(
            F.count(F.lit(1)).alias("texts"), F.sum("lines").alias("lines"), F.min("leaf").alias("leaf"), F.min("size").alias("size"),
            F.bit_or(F.expr("shiftleft(1L, CAST(pmod(body, 64) AS INT))")).alias("bits"),
        )
    )
    counted = store(counted, "templates")
    best = F.struct("all", -F.col("out"), "group")
    alike = generalised(lines, docs, counted, min_docs).groupBy("template").agg(F.max_by("group", best).alias("group"))
    alone = counted.where(F.col("texts") >= min_docs).select("template", F.col("template").alias("group"), "lines")
    return alone.union(counted.where(F.col("texts") < min_docs).join(alike, "template").select("template", "group", "lines"))


def generalised(lines: DataFrame, docs: DataFrame, counted: DataFrame, min_docs: int) -> DataFrame:
    """``template``, ``group``, ``all`` (its size) and ``out`` (places left out) of the groups that recur; a template may be in several."""
    free = F.floor((F.col("size") - DEPTH) * (1 - SIMILAR))
    # Leaves that recur although some of their templates don't.
    leaves = (
        counted.where(free >= 1).groupBy("leaf").agg(F.sum("texts").alias("of"), F.count(F.lit(1)).alias("n"), F.min("texts").alias("rare"))
        .where((F.col("of") >= min_docs) & (F.col("n") > 1) & (F.col("rare") < min_docs)).select("leaf", F.col("n").alias("of"))
    )
    leaves = store(leaves, "leaves")
    few = F.broadcast(leaves) if leaves.count() <= BROADCAST else leaves
    shown = parsed(docs).join(few, "leaf").groupBy("template").agg(F.min("line").alias("line"), F.min("of").alias("of"))
    inner = counted.join(shown, "template").withColumn("tokens", F.slice(F.split("line", " "), F.lit(DEPTH + 1), F.col("size")))
    places = inner.select("leaf", "template", "size", "texts", "bits", "of", F.posexplode("tokens").alias("place", "token")).select(
        "template", "size", "texts", "bits", "of", F.xxhash64("leaf", "place", "token").alias("known"), F.xxhash64("leaf", "place").alias("wild")
    )
    places = store(places, "places")
    tokens = places.groupBy("known").agg(F.sum("texts").alias("with"), F.count(F.lit(1)).alias("n"))
    # A group's number is the xor of its tokens' hashes, so leaving one out costs no look at the others.
    constant = F.col("with") >= min_docs
    differs = F.col("known").bitwiseXOR(F.col("wild"))
    placed = join_counted(places, tokens, "known", "n", places.count(), F.struct("template", "wild"))
    parts = (
        placed.groupBy("template").agg(
            F.min("size").alias("size"), F.min("texts").alias("texts"), F.min("bits").alias("bits"),
            F.bit_xor(F.when(constant, F.col("known")).otherwise(F.col("wild"))).alias("group"),
            F.count_if(~constant).cast("int").alias("out"), (F.min(free) - F.count_if(~constant)).alias("free"),
            F.collect_list(F.when(constant & (F.col("n") < F.col("of")), differs)).alias("more"),
        )
        .where("free >= 0")
    )
    none = F.array().cast("array<bigint>")
    one = F.transform("more", lambda a: F.col("group").bitwiseXOR(a))
    two = F.flatten(F.transform("more", lambda a, i: F.transform(
        F.slice("more", i + 2, F.size("more") - i - 1), lambda b: F.col("group").bitwiseXOR(a).bitwiseXOR(b)
    )))
    several = F.when((F.col("free") >= 2) & (F.col("size") <= DEPTH + PAIRS), two).otherwise(none)
    groups = F.concat(F.array("group"), F.when(F.col("free") >= 1, one).otherwise(none), several)
    members = parts.select("template", "texts", "bits", "out", F.size("more").alias("ones"), F.posexplode(groups).alias("at", "group"))
    more = F.when(F.col("at") == 0, 0).when(F.col("at") <= F.col("ones"), 1).otherwise(2)
    members = members.select("template", "texts", "bits", (F.col("out") + more).alias("out"), "group")
    long = F.col("size") > DEPTH + PAIRS
    if not places.where(long).isEmpty():
        cells = placed.where(long).select(
            "template", "size", "texts", "bits", "wild", F.when(constant, F.col("known")).otherwise(F.col("wild")).alias("cell"),
            F.when(constant & (F.col("n") < F.col("of")), differs).alias("open"),
        )
        members = members.union(pairs_of_places(store(cells, "cells"), free, min_docs))
    members = store(members, "members")
    found = (
        members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("texts").alias("all"), F.max("texts").alias("most"), F.bit_or("bits").alias("bits"), F.min("out").alias("out"))
        .where((F.col("n") > 1) & (F.col("all") >= min_docs))
        # texts with different bits are different texts
        .select("group", "n", "all", "out", ((F.col("most") >= min_docs) | (F.bit_count("bits") >= min_docs)).alias("sure"))
    )
    held = store(join_counted(members.select("template", "group"), found, "group", "n", members.count(), F.col("template")).where("n IS NOT NULL"), "groups")
    sure = held.where("sure").select("template", "group", "all", "out")
    # A text may hold several templates of a group: count the texts themselves where that isn't settled.
    doubtful = held.where("NOT sure").select("template", "group", "all", "out")
    asked = store(doubtful.select("template").distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    bodies = lines.join(asked, "template").select("template", "body").distinct()
    reach = doubtful.join(bodies, "template").groupBy("group").agg(F.count_distinct("body").alias("texts")).where(F.col("texts") >= min_docs)
    return sure.union(doubtful.join(reach.select("group"), "group", "left_semi").select("template", "group", "all", "out"))


def pairs_of_places(cells: DataFrame, free: Column, min_docs: int) -> DataFrame:
    """``template``, ``texts``, ``bits``, ``out`` and ``group`` for pairs of open places that may make a group recur when they are left out.

    ``cells`` has a row per place of a template. Templates that meet with two places left out agree in all others. So the places
    of a leaf are dealt into eight sets by their hash, and sets are halved until they hold few open places. On the way a pair of sets
    stays as long as the templates that agree outside of both have ``min_docs`` texts, and are more than those that agree
    outside of one of the sets alone: otherwise the group with a single place left out has the same lines. Either holds for all
    pairs of places within the sets, so no group is missed.
    """
    heads = store(cells.groupBy("template").agg(
        F.min("texts").alias("texts"), F.min("bits").alias("bits"), F.bit_xor("cell").alias("whole"),
        F.count_if(F.col("cell") == F.col("wild")).cast("int").alias("out"),
        (F.min(free) - F.count_if(F.col("cell") == F.col("wild"))).alias("free"),
    ).where("free >= 0"), "heads")
    level, most = 3, None

    def dealt(level: int) -> DataFrame:
        return cells.withColumn("set", F.shiftrightunsigned("wild", 64 - level))

    sets = dealt(level).groupBy("template").agg(F.array_sort(F.collect_set("set")).alias("sets"))
    state = heads.join(sets, "template").select(*heads.columns, F.explode("sets").alias("a"), "sets")
    state = state.select(*heads.columns, "a", F.explode(F.filter("sets", lambda b: b >= F.col("a"))).alias("b"))
    while True:
        sums = dealt(level).groupBy("template", "set").agg(F.bit_xor("cell").alias("sum"), F.count("open").alias("open"))
        sums = sums.join(heads.select("template", "whole"), "template")
        sums = store(sums.withColumn("rest", F.xxhash64("set", F.col("whole").bitwiseXOR(F.col("sum")))), "sums")
        alike = sums.groupBy("rest").agg(F.count(F.lit(1)).alias("n"))
        sums = store(join_counted(sums, alike, "rest", "n", sums.count(), F.col("template")).drop("rest", "whole"), "alike")
        one = sums.select("template", F.col("set").alias("a"), F.col("sum").alias("sum_a"), F.col("open").alias("open_a"), F.col("n").alias("n_a"))
        two = sums.select("template", F.col("set").alias("b"), F.col("sum").alias("sum_b"), F.col("open").alias("open_b"), F.col("n").alias("n_b"))
        inner = F.col("sum_a").bitwiseXOR(F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.col("sum_b")))
        able = (F.col("open_a") > 0) & (F.col("open_b") > 0) & ((F.col("a") != F.col("b")) | (F.col("open_a") > 1))
        keyed = store(
            state.join(one, ["template", "a"]).join(two, ["template", "b"]).select(
                *heads.columns, "a", "b", "open_a", "open_b", F.when(F.col("a") == F.col("b"), 1).otherwise(F.greatest("n_a", "n_b")).alias("single"),
                F.xxhash64("a", "b", F.col("whole").bitwiseXOR(inner)).alias("key"),
                (able & (F.col("free") >= 2)).alias("able"), (able & (F.col("free") >= 2) & (F.col("texts") < min_docs)).alias("asks"),
            ), "keyed",
        )
        good = keyed.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.max("asks").alias("any"), F.sum("texts").alias("all"),
        ).where((F.col("n") > 1) & F.col("any") & (F.col("all") >= min_docs)).select("key", "n")
        met = join_counted(keyed, good, "key", "n", keyed.count(), F.col("template")).where("n > single")
        met = store(met.drop("key", "n", "single", "asks"), "met")
        most = met.where("able").agg(F.max(F.greatest("open_a", "open_b"))).first()[0]
        if most is None or most <= FEW or level == 62:
            break
        level += 1
        state = met.select(*heads.columns, F.explode(F.expr("array(2 * a, 2 * a + 1)")).alias("a"), "b")
        state = state.select(*heads.columns, "a", F.explode(F.expr("array(2 * b, 2 * b + 1)")).alias("b")).where("a <= b")
    able = met.where("able").select(*heads.columns, "a", "b")
    opened = dealt(level).where("open IS NOT NULL").select("template", "set", "open")
    first = able.join(opened.select("template", F.col("set").alias("a"), F.col("open").alias("x")), ["template", "a"])
    both = first.join(opened.select("template", F.col("set").alias("b"), F.col("open").alias("y")), ["template", "b"])
    both = both.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select("template", "texts", "bits", (F.col("out") + 2).alias("out"), F.col("whole").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y")).alias("group"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", key: str = "doc_id", counts: bool = True) -> DataFrame:
    """All rows and columns with recurring lines taken out of the text, plus ``n_lines`` and ``n_dropped`` unless ``counts`` is false.

    A table that has columns of these names itself needs ``counts=False``.
    """
    if counts and (clash := {"n_lines", "n_dropped"} & set(docs.columns)):
        raise ValueError(f"columns {sorted(clash)} are there already: rename them or set counts=False")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{key}`").alias("id"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.crc32(F.col(f"`{text}`"))).alias("doc"),
    )
    lines = store(parsed(named).drop("line"), "lines")
    flagged = store(join_counted(
        lines.select("doc", "id", "place", "template"),
        recurring(lines, named.select("doc", "id", "text"), min_docs).withColumn("recurs", F.lit(True)),
        "template", "lines", lines.count(), F.struct("doc", "place"),
    ).where("recurs").select("doc", "id", "place", "group"), "flagged")
    first = flagged.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "doc", "place")).alias("first"))
    stay = first.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_set("first.place").alias("stay"))
    dropped = flagged.groupBy("doc").agg(F.collect_set("place").alias("places")).join(stay, "doc", "left")
    gone = F.when(F.col("stay").isNull(), F.col("places")).otherwise(F.array_except("places", "stay"))
    dropped = dropped.select("doc", F.sort_array(gone).alias("places")).where(F.size("places") > 0)
    joined = named.join(dropped.withColumnRenamed("doc", "found"), F.col("doc") == F.col("found"), "left")
    parts = lines_of("text")
    # each run of kept lines between two dropped ones is a slice
    bounds = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.size(parts)))
    kept = F.flatten(F.zip_with(
        F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1),
        lambda a, b: F.slice(parts, a + 2, b - a - 1),
    ))
    shorter = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rest = [shorter.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if not counts:
        return joined.select(*rest)
    return joined.select(
        *rest,
        F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
