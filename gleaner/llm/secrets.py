"""Secret scan: fixed patterns, and character Markov models for random strings the patterns miss. Native columns only.

Two first-order chains over the characters of a token, one for random strings and one for ordinary identifiers, are
counted in Spark from labelled tokens. The score of a token is the sum over its characters of the logarithm of the
two chains' ratio, in thousandths, rounded per transition so that sums are exact. A token is a secret if its score
passes the prior odds of one secret in `odds` tokens.

Positions of matches come from the lengths of the matches and of the pieces between them, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.shared import of_each_label

ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: kind, pattern, group whose length counts, least length, a quick test that any counting match passes
BASE = (("assign", ASSIGN, 2, 12, ASSIGN[:-1].removesuffix("+") + "{12,})"), ("access", ACCESS, 0, 18, r"AKIA[A-Z0-9]{14,}"),
        ("hex", HEX, 0, 16, r"[0-9a-f]{16,}"))
KINDS = ("assign", "access", "hex", "markov")
SPAN = "struct<start:int,end:int,kind:int>"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
BLOCK = 256


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda n, x: n + x)


def match_spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, end, kind>> of the matches whose (match, index from 1) passes `keep`; ends are exclusive.

    Starts are running sums of piece and match lengths, by blocks so that a text with very many matches stays cheap.
    """
    def located(matches: Column, lengths: Column) -> Column:
        def with_blocks(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                # lengths alternate: piece, match, piece, match, …; the start of match i is the sum of the first 2 i + 1
                n = 2 * i + 1
                full = F.floor(n / BLOCK).cast("int")
                start = F.get(before, full) + _total(F.slice(lengths, full * BLOCK + 1, n - full * BLOCK))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"))

            found = F.transform(matches, one)
            return F.filter(found, lambda s, i: keep(F.get(matches, i), i + 1))

        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")),
                             lambda b: _total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
        return let(let(blocks, lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: F.when(
            b == 0, F.lit(0)).otherwise(_total(F.slice(sums, 1, b))))), with_blocks)

    pieces = F.transform(F.split(text, pattern), lambda x: F.length(x))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: let(
        let(pieces, lambda p: F.flatten(F.transform(p, lambda n, i: F.array(n, F.coalesce(F.length(F.get(matches, i)), F.lit(0)))))),
        lambda lengths: located(matches, lengths)))


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns by start, then kind. A null text has none."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(kind: int) -> Column:
        _, pattern, group, least, quick = BASE[kind]
        if group == 0:
            spans = match_spans(text, pattern, kind, lambda m, i: F.length(m) >= least)
        else:
            spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
                        lambda values: match_spans(text, pattern, kind, lambda m, i: F.length(F.get(values, i - 1)) >= least))
        return F.when(F.regexp_like(text, F.lit(quick)), spans.cast(f"array<{SPAN}>")).otherwise(none)

    return F.array_sort(F.concat(*[of(k) for k in range(len(BASE))]))


class TokenModel:
    """Log-likelihood ratios by (previous, next) character, in thousandths; none when there was nothing to learn from."""

    def __init__(self, ratios: list[int] | None, odds: float = 1000.0, least: int = 12):
        self.ratios, self.threshold, self.least = ratios, round(1000 * math.log(odds)), least

    def score(self, token: Column) -> Column:
        table = F.split(F.lit(" ".join(map(str, self.ratios))), " ").cast("array<int>")
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("sum"))

        def step(s: Column, c: Column) -> Column:
            return F.struct(c.alias("at"), (s["sum"] + F.get(table, s["at"] * STATES + c)).alias("sum"))

        return F.aggregate(state_numbers(token), start, step, lambda s: s["sum"])

    def spans(self, text: Column) -> Column:
        """Runs of token characters that score as random, and in the other runs the pieces without separators that do."""
        none = F.array().cast(f"array<{SPAN}>")
        if self.ratios is None:
            return none
        runs, pieces = ("[%s]{%d,}" % (chars, self.least) for chars in ("A-Za-z0-9+/_=-", "A-Za-z0-9"))
        found = lambda pattern: match_spans(text, pattern, len(BASE), lambda m, i: self.score(m) >= self.threshold)
        both = let(F.struct(found(runs).alias("whole"), found(pieces).alias("part")), lambda f: F.concat(f["whole"], F.filter(
            f["part"], lambda p: ~F.exists(f["whole"], lambda w: (w["start"] <= p["start"]) & (w["end"] >= p["end"])))))
        return F.when(F.regexp_like(text, F.lit(runs)), both.cast(f"array<{SPAN}>")).otherwise(none)


def state_numbers(token: Column) -> Column:
    """The characters of a token as numbers from 1; 0 for any outside the alphabet."""
    codes = F.split(F.lit(" ".join(str(ALPHABET.find(chr(c)) + 1) for c in range(128))), " ").cast("array<int>")
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(codes, F.ascii(c)), F.lit(0)))


def train(labelled: DataFrame, *, random_weight: float = 0.5, plain_weight: float = 0.05, odds: float = 1000.0, least: int = 12) -> TokenModel:
    """Fits on (token, secret boolean). The weights are added to every transition's count: the chain of random strings
    stays near to uniform where it saw little, the other one does not expect what it never saw.

    Rows with a null are left out. Without tokens of both labels the model finds nothing.
    """
    pairs = labelled.filter(F.col("token").isNotNull() & F.col("secret").isNotNull()).select("secret", F.explode(let(
        state_numbers(F.col("token")), lambda s: F.transform(s, lambda c, i: F.struct(
            F.when(i > 0, F.get(s, i - 1)).otherwise(0).alias("before"), c.alias("after"))))).alias("p"))
    counts = pairs.groupBy("secret", "p.before", "p.after").count().collect()
    n = {True: {}, False: {}}
    for r in counts:
        n[r.secret][r.before, r.after] = r["count"]
    if not n[True] or not n[False]:
        return TokenModel(None)
    logs = {}
    for secret, weight in ((True, random_weight), (False, plain_weight)):
        for a in range(STATES):
            total = sum(n[secret].get((a, b), 0) for b in range(STATES)) + weight * STATES
            for b in range(STATES):
                logs[secret, a, b] = math.log((n[secret].get((a, b), 0) + weight) / total)
    return TokenModel([round(1000 * (logs[True, a, b] - logs[False, a, b])) for a in range(STATES) for b in range(STATES)], odds, least)


def long_enough(tokens: Column, least: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= least)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def labelled_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1_000, least: int = 8) -> DataFrame:
    """(token, secret) from a bounded sample: values of fixed-pattern matches, and the other tokens of documents without any.

    At most `max_docs` documents of either kind are used, those whose id has the smallest hashes among all of that kind.
    """
    quick = "|".join(q for *_, q in BASE)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = of_each_label(rows.withColumn("has", F.regexp_like("text", F.lit(quick))), "has", F.col("id"), max_docs, ["text"])
    hits = [long_enough(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), enough) for _, pattern, group, enough, _ in BASE]
    plain = F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{%d,}" % least), F.lit(0))
    return some.select(F.explode(F.when(F.col("has"), F.concat(*hits)).otherwise(plain)).alias("token"), F.col("has").alias("secret"))


def scan(docs: DataFrame, model: TokenModel, *, text_col: str = "text", out: str = "found") -> DataFrame:
    """Adds out = struct(base, spans): arrays of (start, end, kind) by start, then kind, in code points, ends exclusive.

    The model's spans that lie inside a pattern's span are left out. A null text counts as empty; every row and column is
    kept, but a column named as `out` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.drop(out).withColumn(out, F.struct(base_spans(text).alias("base"), model.spans(text).alias("more")))
    both = let(F.col(out), lambda s: F.struct(s["base"].alias("base"), F.when(F.size(s["more"]) == 0, s["base"]).otherwise(
        F.array_sort(F.concat(s["base"], F.filter(s["more"], lambda m: ~F.exists(s["base"], lambda b: (b["start"] <= m["start"]) & (
            b["end"] >= m["end"])))))).alias("spans")))
    return base.withColumn(out, both)


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by one mark; spans are sorted by start."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        joined = F.when(x["start"] < s["at"], s["parts"]).otherwise(
            F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))))
        return F.struct(joined.alias("parts"), F.greatest(s["at"], x["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
