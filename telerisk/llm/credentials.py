"""Secrets in text: strong patterns, and weak parts that count only beside their complements.

Everything is DataFrame expressions.  A pattern's matches are marked in the text and split off, and running
lengths give their code-point spans.  Weak parts (account names, endpoints, token-like strings) are interval-joined
inside their scope: blocks up to a blank line are scopes, and over a document's spans in order, running extremes give each part the
nearest identifier, secret and endpoint before and after it, so no pair of parts is ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telerisk.llm.keys import NULL_ID, keyed, public_id
from telerisk.session import materialise

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a maximal run of enough characters is what a run of any length leaves after the length test
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ACCOUNT = r"""(?:(?i:username|user|login|account|client_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"""
# whole runs, of which those with a letter and a digit count; a run is read once, however long it is
OPAQUE = r"[A-Za-z0-9/+_-]{20,}"
MIXED = ("[0-9]", "[A-Za-z]")
BLANK = r"\n[\x20\x09\x0D]*\n"
#: kinds in the order in which spans with one start are listed
KINDS = ("assign", "access", "hex", "account", "endpoint", "opaque")
BASE, WEAK = KINDS[:3], KINDS[3:]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "account"), ("assign", "hex", "opaque"), ("endpoint",)
#: code points between complementary parts, at most
REACH = 200
_OPEN, _CLOSE, _CHUNK = "\x01", "\x02", 256


def spans(text: Column, pattern: str, least: int = 0, holds: tuple[str, ...] = ()) -> Column:
    """Array of (start, end) of the matches, in code points; of those whose first group has ``least`` characters
    and that hold a match of each of ``holds``.

    ``text`` must hold neither marker.  Running sums are taken in chunks of matches, so the work stays
    near the number of matches.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def found(p: Column) -> Column:
        size = F.transform(p, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0))
        chunks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int"))
        total = F.transform(chunks, lambda k: F.aggregate(F.slice(size, k * _CHUNK + 1, _CHUNK), F.lit(0), lambda a, x: a + x))
        before = F.aggregate(total, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def chunk(k: Column) -> Column:
            state = F.struct(F.element_at(before, k + 1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

            def step(s: Column, piece: Column) -> Column:
                hit = F.substring_index(piece, _CLOSE, 1)
                marked = F.contains(piece, F.lit(_CLOSE))
                end = s["at"] + F.length(hit)
                good = marked & (F.length(F.regexp_extract(hit, pattern, 1)) >= least) if least else marked
                for part in holds:
                    good &= F.rlike(hit, F.lit(part))
                one = F.array(F.struct(s["at"].cast("int").alias("start"), end.cast("int").alias("end")))
                return F.struct((s["at"] + F.length(piece) - F.when(marked, 1).otherwise(0)).alias("at"),
                                F.when(good, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))
            return F.aggregate(F.slice(p, k * _CHUNK + 1, _CHUNK), state, step, lambda s: s["out"])

        return F.when(F.size(p) > 1, F.flatten(F.transform(chunks, chunk))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    # the pieces are bound once, as the one element of an array
    return F.element_at(F.transform(F.array(pieces), found), 1)


def ordered(parts: Column) -> Column:
    """kind:start:end of (start, kind number, end), by start and kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(
        ":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def tagged(column: str, kind: str) -> Column:
    return F.transform(F.col(column), lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts of ``parts(doc, copy, start, kind, end)`` that have their complements in the same block.

    Blank lines come as rows of kind -1.  An account needs a secret, an opaque string an identifier or an endpoint,
    an endpoint both an identifier and a secret; each at most ``reach`` code points away.
    """
    number = {k: i for i, k in enumerate(KINDS)}
    of = lambda names: F.col("kind").isin([number[k] for k in names])
    block = Window.partitionBy("doc", "copy").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    scope = Window.partitionBy("doc", "copy", "block").orderBy("start", "kind", "end")
    earlier, later = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    rows = parts.withColumn("block", F.sum(F.when(F.col("kind") < 0, 1).otherwise(0)).over(block)).where("kind >= 0")
    # an opaque string that meets another part is that part
    other = ~of(["opaque"])
    met = (F.max(F.when(other, F.col("end"))).over(earlier) > F.col("start")) | (F.min(F.when(other, F.col("start"))).over(later) < F.col("end"))
    rows = rows.withColumn("met", F.coalesce(met, F.lit(False))).where(other | ~F.col("met"))

    def near(names) -> Column:
        before = F.col("start") - F.max(F.when(of(names), F.col("end"))).over(earlier) <= reach
        after = F.min(F.when(of(names), F.col("start"))).over(later) - F.col("end") <= reach
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    rows = rows.withColumns({"i": near(IDENTIFIERS), "s": near(SECRETS), "e": near(ENDPOINTS)})
    keep = ((of(["account"]) & F.col("s")) | (of(["opaque"]) & (F.col("i") | F.col("e")))
            | (of(["endpoint"]) & F.col("i") & F.col("s")))
    return rows.where(keep).select("doc", "copy", "start", "kind", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``doc_id``, ``copy``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``parts`` of each document.

    ``spans`` lists all spans as kind:start:end; ``parts`` holds them as (start, kind, end).  Null and empty texts
    have no spans.  Rows equal in id and text give one row; ``copy`` numbers different texts under one id.  Other
    columns are not read; an empty table gives an empty result.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    text = F.translate("text", _OPEN + _CLOSE, "\x03\x03")
    found = keyed(docs, id_col, text_col).select("doc", "copy", text.alias("text")).select(
        "doc", "copy", "text", spans(F.col("text"), ASSIGN, 8).alias("assign"), spans(F.col("text"), ACCESS).alias("access"),
        spans(F.col("text"), HEX).alias("hex"), spans(F.col("text"), ACCOUNT).alias("account"),
        spans(F.col("text"), ENDPOINT).alias("endpoint"), spans(F.col("text"), OPAQUE, holds=MIXED).alias("opaque"))
    base = F.concat(*[tagged(k, k) for k in BASE])
    weak = F.concat(*[tagged(k, k) for k in WEAK])
    several = (F.size("account") + F.size("endpoint") + F.size("opaque") > 0) & (F.size(base) + F.size(weak) > 1)
    blanks = F.transform(spans(F.col("text"), BLANK), lambda s: F.struct(
        s["start"].alias("start"), F.lit(-1).alias("kind"), s["end"].alias("end")))
    found = materialise(found.select("doc", "copy", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], base.alias("base"),
                                     F.when(several, F.concat(base, weak, blanks)).otherwise(empty).alias("all")), "spans")
    parts = found.where(F.size("all") > 0).select("doc", "copy", F.explode("all").alias("p")).select("doc", "copy", "p.*")
    more = linked(parts, reach).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    every = F.array_sort(F.concat("base", F.coalesce("more", empty)))
    return found.join(more, ["doc", "copy"], "left").select(
        public_id().alias("doc_id"), "copy", *[f"n_{k}" for k in BASE], F.sha2(ordered(F.col("base")), 256).alias("base_sha256"),
        ordered(every).alias("spans"), every.alias("parts"))


#: kinds whose text is taken out; accounts and endpoints stay
TAKEN = ("assign", "access", "hex", "opaque")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each run of secret spans in the text replaced by ``mark``; all rows and columns stay.

    Null texts stay null; rows repeated or with a null id are redacted like any other; an empty table stays empty.
    """
    shared = docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
    # rows that share an id are told apart by a hash of id and text
    key = F.xxhash64(id_col, text_col) if shared else F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), F.col(text_col).alias("text"))
    taken = F.filter("parts", lambda p: p["kind"].isin([KINDS.index(k) for k in TAKEN]))
    found = scan(rows.select("key", "text"), "key", "text").select(
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("key"), taken.alias("taken")).where(F.size("taken") > 0)
    found = found.dropDuplicates(["key"]) if shared else found
    text = F.col("text")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fresh = p["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.when(fresh, F.concat(
            s["out"], text.substr(s["at"] + 1, p["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("taken", state, step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    joined = rows.join(found, "key", "left")
    return joined.select(*[F.when(F.col("taken").isNull(), text).otherwise(clean).alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
