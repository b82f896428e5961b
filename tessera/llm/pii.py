"""Personal data: pattern matches as seeds, bootstrapped contextual extraction
for identifiers no pattern knows.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash

# The base patterns, leftmost and non-overlapping.  Possessive
# quantifiers and the look at the character before keep them linear and free
# of deep recursion; they match the same spans as their plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text with a match holds in any case: a cheap look before the search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A white-space-delimited token with a digit or an at sign.
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Such a token, or several with digits that only single spaces separate.
GROUPED = (r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*+[0-9][^\x20\x09-\x0D@]*+(?![^\x20\x09-\x0D])"
           r"(?:(?<![.,;:!?])\x20[^\x20\x09-\x0D0-9@]*+[0-9][^\x20\x09-\x0D@]*+(?![^\x20\x09-\x0D]))*+"
           r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)")
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class PiiConfig:
    """``context``: words before a mention that form its lexical pattern, taken
    from the last ``reach`` characters.  A pattern is trusted from
    ``confidence`` and ``seeds`` different seed instances on."""

    context: int = 1
    reach: int = 80
    rounds: int = 3
    confidence: float = 0.6
    seeds: int = 3


def matches(text: Column, pattern: str, reach: int = 0) -> Column:
    """array<struct<s, e, m, before>>: start and end (code points, end
    exclusive), text, and the ``reach`` characters before each match.

    The matches are marked in the text by two characters that no pattern
    matches (where the text has them, a third takes their place), which is
    then split at the marks and its pieces' lengths added up.
    """
    held = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)),
                  F.translate(text, OPEN + CLOSE, OTHER + OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(held, pattern, OPEN + "$0" + CLOSE), OPEN)
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")
    start = F.struct(F.char_length(pieces[0]).alias("at"), F.right(pieces[0], F.lit(reach)).alias("before"),
                     none.alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        m = F.substring_index(piece, CLOSE, 1)
        gap = F.substr(piece, F.char_length(m) + 2)
        end = acc["at"] + F.char_length(m)
        one = F.struct(acc["at"].alias("s"), end.alias("e"), m.alias("m"), acc["before"].alias("before"))
        return F.struct((end + F.char_length(gap)).alias("at"), F.right(gap, F.lit(reach)).alias("before"),
                        F.concat(acc["out"], F.array(one)).alias("out"))
    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, add, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def part(x: Column) -> Column:
            short = F.ltrim(x, F.lit("0"))
            value = F.when(short == "", 0).otherwise(F.substring(short, 1, 3).cast("int"))
            return (F.char_length(short) <= 3) & (value <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return F.char_length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, e>> of a kind's valid matches, in order."""
    found = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"])),
                        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def mentions(text: Column, cfg: PiiConfig, tokens: str = GROUPED) -> Column:
    """array<struct<s, e, m, pattern>>: identifier-like tokens, neighbouring
    groups as one, without the punctuation at their ends, each with its lexical pattern: the lower-case
    words before it, ^ at the beginning of the text, # for other mentions."""
    def view(x: Column) -> Column:
        lead = F.char_length(x["m"]) - F.char_length(F.regexp_replace(x["m"], r"^[^\p{L}\p{N}+@]+", ""))
        core = F.regexp_replace(x["m"], r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]++$", "")
        words = F.filter(F.split(F.lower(x["before"]), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        near = F.array_join(F.slice(words, F.greatest(F.size(words) - cfg.context + 1, F.lit(1)),
                                    F.lit(cfg.context)), " ")
        pattern = F.when(near != "", near).when(x["s"] == 0, "^").otherwise("#")
        return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.char_length(core)).alias("e"),
                        core.alias("m"), pattern.alias("pattern"))
    found = F.filter(F.transform(matches(text, tokens, cfg.reach), view), lambda x: F.regexp_replace(x["m"], r"[+@]", "") != "")
    none = F.array().cast("array<struct<s:int,e:int,m:string,pattern:string>>")
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


# --- bootstrapping -----------------------------------------------------------------

def score_patterns(seen: DataFrame, cfg: PiiConfig, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (pattern, p) and instances (m, r) from their graph.

    ``seen`` has a row for each mention: pattern, m, seed.  A seed instance
    counts 1 throughout.  In each round a pattern scores the weighted mean of
    its instances, with one unscored instance added; it is trusted if that
    reaches ``confidence`` over at least ``seeds`` different seeds; another
    instance scores the weighted mean of its trusted patterns.
    """
    edges = stash.keep(seen.groupBy("pattern", "m").agg(
        F.count("*").alias("w"), F.max("seed").alias("seed")))
    instances = stash.keep(edges.groupBy("m").agg(F.max("seed").alias("seed"))
                           .select("m", "seed", F.col("seed").cast("double").alias("r")))
    patterns = None
    for _ in range(cfg.rounds):
        scored = (edges.drop("seed").join(instances, "m").groupBy("pattern")
                  .agg((F.sum(F.col("w") * F.col("r")) / (F.sum("w") + 1)).alias("p"),
                       F.sum(F.col("seed").cast("int")).alias("seeds")))
        patterns = stash.keep(scored.where((F.col("p") >= cfg.confidence) & (F.col("seeds") >= cfg.seeds))
                              .select("pattern", "p"))
        reached = (edges.drop("seed").join(patterns, "pattern", "left").groupBy("m")
                   .agg((F.sum(F.col("w") * F.coalesce("p", F.lit(0.0))) / F.sum("w")).alias("mean")))
        instances = stash.keep(instances.join(reached, "m").select(
            "m", "seed", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("mean")).alias("r")))
    return patterns, instances.select("m", "r")


def find_personal_data(spark: SparkSession, docs: DataFrame, cfg: PiiConfig = PiiConfig(),
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, id) for every row: arrays of spans
    (s, e) in code points, end exclusive, in order.

    The first four are the base patterns' valid matches.  Tokens that overlap
    one are the seeds; the lexical patterns they induce are scored with all
    instances (``score_patterns``), and ``id`` holds the other mentions
    behind a trusted pattern whose own score reaches ``confidence``, of any
    length; neighbouring tokens with digits are one mention.

    Null and empty texts have no spans; repeated rows get equal results; null
    ids stay null; an empty table gives an empty result; other columns are
    not read.
    """
    stash = Stash(spark, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *[base_spans(text, k).alias(k) for k in KINDS], mentions(text, cfg).alias("mention"))
    found = stash.keep(rows)
    near = F.concat(*[F.col(k) for k in KINDS])
    overlap = F.exists("base", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s")))
    whole = F.exists("base", lambda b: (b["s"] <= F.col("x.s")) & (b["e"] >= F.col("x.e")))
    # groups that a base match is only part of fall into their tokens again
    inner = F.transform(mentions(F.col("x.m"), cfg, MENTION), lambda t: F.struct(
        (F.col("x.s") + t["s"]).alias("s"), (F.col("x.s") + t["e"]).alias("e"), t["m"].alias("m"),
        F.when(t["s"] == 0, F.col("x.pattern")).otherwise(t["pattern"]).alias("pattern")))
    each = found.select("row", near.alias("base"), F.explode("mention").alias("x")).select(
        "row", "base", F.explode(F.when(F.contains(F.col("x.m"), F.lit(" ")) & overlap & ~whole, inner)
                                 .otherwise(F.array("x"))).alias("x")).select("row", "x.*", overlap.alias("seed"))
    each = stash.keep(each)
    patterns, instances = score_patterns(each.select("pattern", "m", "seed"), cfg, stash)
    new = (each.where(~F.col("seed")).join(patterns, "pattern", "left_semi")
           .join(instances.where(F.col("r") >= cfg.confidence), "m", "left_semi")
           .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("id")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return (found.drop("mention").join(new, "row", "left")
            .select("doc_id", *KINDS, F.coalesce("id", none).alias("id")))


def span_list(columns: dict[str, str]) -> Column:
    """kind:start:end of all spans, in the order of the columns, comma-joined."""
    def named(kind: str, column: str) -> Column:
        return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))
    return F.array_join(F.concat(*[named(k, c) for k, c in columns.items()]), ",")


def mask(text: Column, spans: Column, sign: str = "█") -> Column:
    """The text with every span's characters replaced by ``sign``."""
    def hide(acc: Column, x: Column) -> Column:
        n = x["e"] - x["s"]
        return F.concat(F.substr(acc, F.lit(1), x["s"]), F.repeat(F.lit(sign), n), F.substr(acc, x["e"] + 1))
    return F.aggregate(spans, text, hide)
