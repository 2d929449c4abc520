"""Structure of unknown lines: atoms by kind, words that nearly all lines hold, and groups of lines of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

# Kinds of atoms and their patterns, in the order in which they are tried at each place of a line.
KINDS = (
    ("TS", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"),
    ("TS2", r"[A-Z][a-z]{2}\s+\d{1,2}\s+(?:\d{4}\s+)?\d\d:\d\d:\d\d"),
    ("UUID", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    ("MAC", r"[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}"),
    ("IP", r"(?:\d{1,3}\.){3}\d{1,3}"),
    ("TIME", r"\d\d:\d\d:\d\d"),
    ("HEX", r"0x[0-9a-fA-F]+"),
    ("NUM", r"-?\d+(?:\.\d+)?"),
    ("WORD", r"[A-Za-z_][\w.-]*"),
    ("SP", r"\s+"),
    ("PAREN", r"\([^()\s][^()]*\)"),
    ("PUNCT", r"->|=>|<-|[^\n]"),
)
#: Kinds that are structure by themselves, what a value stands right behind, and what a clause's keyword stands before.
FIXED, BEFORE_VALUE, CLAUSE_VALUE = ("SP", "PUNCT"), (":", "=", "("), ("IP", "NUM", "MAC", "PAREN")
_ATOM = "(?U)" + "|".join(pattern for _, pattern in KINDS)


def atoms(line: Column) -> Column:
    """The atoms of a whole line in order, as structs of kind and text; together their texts are the line.

    A kind is told from the atom alone: the first pattern that matches all of it is the one that found it, since all are
    tried in that order at each place and none looks beyond its atom. A null line is null, an empty one has no atoms.
    """

    def kind(text: Column) -> Column:
        found = F.lit(KINDS[-1][0])
        for name, pattern in reversed(KINDS[:-1]):
            found = F.when(text.rlike(rf"(?U)\A(?:{pattern})\z"), name).otherwise(found)
        return found

    # One pass finds all atoms with their kinds: a pattern for each kind puts its atom behind as many marks as its number.
    cut, mark = "\x01", "\x02"
    each = "(?U)" + "|".join(f"({pattern})" for _, pattern in KINDS)
    marked = F.regexp_replace(line, each, cut + mark.join(f"${i}" for i in range(1, len(KINDS) + 1)))
    pieces = F.filter(F.split(marked, cut, -1), lambda x: x != "")
    names = F.array(*[F.lit(name) for name, _ in KINDS])
    read = F.transform(pieces, lambda x: bound(F.ltrim(x, F.lit(mark)), lambda left: F.struct(names[F.length(x) - F.length(left)].alias("kind"), F.rtrim(left, F.lit(mark)).alias("text"))))
    apart = F.transform(F.regexp_extract_all(line, F.lit(_ATOM), F.lit(0)), lambda x: F.struct(kind(x).alias("kind"), x.alias("text")))
    return F.when(line.contains(cut) | line.contains(mark), apart).otherwise(read)


def _texts(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["text"]))


def word_table(rows: DataFrame, of: str = "atoms") -> DataFrame:
    """(word, n, valued, clause) of all words: lines that hold it, and whether it stands anywhere right behind one of
    ``BEFORE_VALUE``, or behind a comma and before a value (white space aside).

    One row a word leaves each task, however many lines hold it.
    """
    a = F.col(of)
    solid = rows.select(of, F.filter(a, lambda x: x["kind"] != "SP").alias("__solid"))
    s = F.col("__solid")
    valued = F.filter(a, lambda x, i: (x["kind"] == "WORD") & F.coalesce(F.get(a, i - 1)["text"].isin(*BEFORE_VALUE), F.lit(False)))
    comma = lambda i: (F.get(s, i - 1)["kind"] == "PUNCT") & (F.get(s, i - 1)["text"] == ",")
    clause = F.filter(s, lambda x, i: (x["kind"] == "WORD") & F.coalesce(comma(i), F.lit(False)) & F.coalesce(F.get(s, i + 1)["kind"].isin(*CLAUSE_VALUE), F.lit(False)))
    said = lambda words, n, v, c: F.transform(_texts(words), lambda w: F.struct(w.alias("word"), F.lit(n).cast("long").alias("n"), F.lit(v).alias("valued"), F.lit(c).alias("clause")))
    each = F.concat(said(F.filter(a, lambda x: x["kind"] == "WORD"), 1, False, False), said(valued, 0, True, False), said(clause, 0, False, True))
    return solid.select(F.explode(each).alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n"), F.max("x.valued").alias("valued"), F.max("x.clause").alias("clause"))


def groups(lines: DataFrame, text: str, key: str, share: float = 0.9) -> DataFrame:
    """Lines by shape: shape_id, skeleton, n, share, first_key and nodes (structs of kind, text and literal, in order).

    White space, marks and constants are literal: words in at least ``share`` of the lines that nowhere stand as a value. So
    is a keyword: a word of letters only that is the only one at its place in the group, is in two lines at least, stands
    nowhere as a value and opens a clause somewhere. Everything else is a variable of its kind; its node's text is null, and
    the skeleton shows ``<KIND>``. Null lines are left out, empty ones are a shape of no nodes.

    Lines are cut twice and not held: once to count words, once to count shapes and the words at places, all by partial
    sums, so that neither a word nor a shape that all lines have is one task. There are no more constants than a line has
    words on average, divided by ``share``: that bounds what is broadcast.
    """
    rows = lines.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), atoms(F.col(text)).alias("atoms"))
    words = word_table(rows)
    total = rows.agg(F.count("*").alias("__all"))
    steady = words.filter(~F.col("valued")).crossJoin(F.broadcast(total)).filter(F.col("n") >= F.col("__all") * share).agg(F.collect_list("word").alias("__steady"))
    held = lambda x: x["kind"].isin(*FIXED) | (x["kind"] == "WORD") & F.array_contains(F.col("__steady"), x["text"])
    shaped = rows.crossJoin(F.broadcast(steady)).withColumn("shape", F.transform("atoms", lambda x: F.struct(x["kind"].alias("kind"), F.when(held(x), x["text"]).alias("text"))))
    shape_id = F.sha2(F.to_json("shape"), 256).alias("shape_id")
    # Shapes are the groups themselves, and words are told apart before they are compared: both are sums in hash tables, while
    # to keep an array or a text for each group would sort all lines.
    counts = shaped.groupBy("shape").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).select("*", shape_id)
    # Only words that aren't constants can be keywords; of each place only the least and the greatest word matter.
    open_words = F.filter(F.transform("atoms", lambda x, i: F.when((x["kind"] == "WORD") & ~F.array_contains(F.col("__steady"), x["text"]), F.struct(i.alias("place"), x["text"].alias("word")))), lambda x: x.isNotNull())
    seen = shaped.select(shape_id, F.explode(open_words).alias("x")).groupBy("shape_id", "x.place", "x.word").agg(F.count("*").alias("__n"))
    places = seen.groupBy("shape_id", "place").agg(F.min("word").alias("word"), F.max("word").alias("__last"))
    able = words.filter((F.col("n") >= 2) & F.col("clause") & ~F.col("valued") & F.col("word").rlike(r"\A\p{L}+\z")).select("word")
    keywords = places.filter(F.col("word") == F.col("__last")).join(able, "word").groupBy("shape_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "word"))).alias("__keywords"))
    joined = counts.join(keywords, "shape_id", "left").crossJoin(F.broadcast(total))
    put = F.transform("shape", lambda x, i: F.struct(x["kind"].alias("kind"), F.coalesce(x["text"], F.try_element_at("__keywords", i)).alias("text")))
    nodes = F.transform(put, lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["text"].isNotNull().alias("literal")))
    skeleton = F.array_join(F.transform("nodes", lambda x: F.coalesce(x["text"], F.concat(F.lit("<"), x["kind"], F.lit(">")))), "")
    return joined.withColumn("nodes", nodes).select(F.substring("shape_id", 1, 16).alias("shape_id"), skeleton.alias("skeleton"), "n", (F.col("n") / F.col("__all")).alias("share"), "first_key", "nodes")
