"""Claim matching between arms: pairs, agreement, scoreboards, disagreement examples.

Facts are shuffled and sorted by record once and matched as a stream: a task holds the reference facts of one record
and those of one other arm. Facts of equal wording are matched as one group with several places, and only groups that
share a word or a phrase are scored, so repeats and long records do not multiply. A record too large for a task can be
matched by joins instead (`match_by_rounds`), with the same result; that is for the caller to say.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner import constants as K
from gleaner.functions.facts import claim_phrases, claim_score, claim_words
from gleaner.operators.facets import top_n_per_group
from gleaner.operators.prefix import running_rank
from gleaner.operators.ranking import round_robin
from gleaner.session import cut_lineage, dealt_by


# --- variants ----------------------------------------------------------------
def explode_variants(records: DataFrame) -> DataFrame:
    """(record_id, arm, variant fields) from the records' variant maps."""
    return (records.select(F.col("id").alias("record_id"), F.explode("variants").alias("arm", "v"))
            .select("record_id", "arm", "v.*"))


def variant_measures(variants: DataFrame) -> DataFrame:
    """What the scoreboard adds up, one row per stored variant."""
    t = F.col("tokens")
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return variants.select(
        "record_id", "arm", F.col("model"),
        size("facts").alias("facts"), size("tags").alias("tags"),
        F.length(F.coalesce("summary", F.lit(""))).alias("summary_chars"),
        F.coalesce("elapsed_s", F.lit(0.0)).alias("seconds"),
        F.coalesce(t["cost_usd"], F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.size(F.map_keys("structured")), F.lit(0)).alias("structured_fields"),
        F.coalesce(t["salvaged"], F.lit(False)).alias("salvaged"))


def scoreboard(measures: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Per arm: totals, averages, cost per record, empty and salvaged counts."""
    if sample is not None:
        measures = measures.join(sample.select(F.col("id").alias("record_id")), "record_id", "left_semi")
    summed = ("facts", "tags", "summary_chars", "seconds", "structured_fields")
    board = measures.groupBy("arm").agg(
        F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in summed],
        F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("facts") == 0).alias("empty"),
        F.count_if("salvaged").alias("salvaged"))
    n = F.col("records")
    return board.select(
        "arm", "records", *summed, "cost_usd", "empty", "salvaged",
        *[(F.col(c) / n).alias(f"avg_{c}") for c in summed],
        (F.col("cost_usd") / n).alias("cost_per_record"), (F.col("empty") / n).alias("empty_rate"))


def variant_pairs(variants: DataFrame, reference: str) -> DataFrame:
    """Reference variant beside every other variant of the same record: struct columns ref, cand."""
    cols = [c for c in variants.columns if c != "record_id"]
    ref = variants.filter(F.col("arm") == reference).select("record_id", F.struct(*cols).alias("ref"))
    cand = variants.filter(F.col("arm") != reference).select("record_id", F.struct(*cols).alias("cand"))
    return ref.join(cand, "record_id")


# --- matching ----------------------------------------------------------------
class Wordings:
    """One arm's facts of one record by wording (words and phrases), with the free places of each in order."""

    def __init__(self, facts: list[tuple]):
        self.places: dict[tuple, list] = defaultdict(list)
        for pos, _, words, phrases in facts:
            self.places[words, phrases].append(pos)
        self.by_word: dict[str, set] = defaultdict(set)
        for wording in self.places:
            for key in (*wording[0], *((p,) for p in wording[1])):
                self.by_word[key].add(wording)
        self.next = dict.fromkeys(self.places, 0)
        self.ranked: dict[tuple, list[tuple[float, list]]] = {}

    def candidates(self, wording: tuple) -> list[tuple[float, list]]:
        """(score, wordings) above the threshold, best first."""
        if wording not in self.ranked:
            words, phrases = wording
            if words:
                near = set().union(*(self.by_word.get(k, ()) for k in (*words, *((p,) for p in phrases))))
            else:
                near = {w for w in self.places if not w[0]}
            scores = defaultdict(list)
            for other in near:
                score = wording_score(wording, other)
                if score >= K.CLAIM_MATCH_THRESHOLD:
                    scores[score].append(other)
            self.ranked[wording] = sorted(scores.items(), reverse=True)
        return self.ranked[wording]

    def take(self, wording: tuple) -> tuple | None:
        """(place, score) of the best free partner, the first in order among equals; it is free no more."""
        for score, others in self.candidates(wording):
            free = [(self.places[o][self.next[o]], o) for o in others if self.next[o] < len(self.places[o])]
            if free:
                place, other = min(free, key=lambda x: x[0])
                self.next[other] += 1
                return place, score
        return None


def wording_score(a: tuple, b: tuple) -> float:
    """`claim_score` of two (words, phrases)."""
    (wa, pa_), (wb, pb) = a, b
    if not wa or not wb:
        return 1.0 if not wa and not wb else 0.0
    if pa_ & pb:
        return K.CLAIM_PHRASE_SCORE
    shared, shorter = len(wa & wb), min(len(wa), len(wb))
    jaccard = shared / (len(wa) + len(wb) - shared)
    return max(jaccard, shared / shorter) if shorter >= 2 and shared / shorter >= K.CLAIM_CONTAINMENT else jaccard


def match_arm(reference: list[tuple], other: list[tuple]) -> tuple[dict, dict]:
    """Places matched one to one, from either side: {pos: (other pos, score)}. Facts are (pos, text, words, phrases) in order."""
    free, left, right = Wordings(other), {}, {}
    for pos, _, words, phrases in reference:
        hit = free.take((words, phrases))
        if hit:
            left[pos] = hit
            right[hit[0]] = (pos, hit[1])
    return left, right


def match_facts(facts: DataFrame, reference: str) -> DataFrame:
    """Every fact of the compared arms with its outcome.

    facts(record_id, arm, pos, text) -> (record_id, arm, side, pos, text, other_pos, score): `arm` is the
    candidate arm, `side` is ref or cand, and `other_pos`/`score` are null for unmatched facts.
    Reference facts in order each take their best free partner, the earliest among equals.
    """
    kind = {f.name: f.dataType.simpleString() for f in facts.schema}
    keyed = facts.select("record_id", (F.col("arm") == reference).alias("own"), "arm", "pos", "text",
                         claim_words("text").alias("words"), claim_phrases("text").alias("phrases"))
    names = ["record_id", "arm", "side", "pos", "text", "other_pos", "score"]

    def settle(record, own: list, arm: str, other: list, out: list) -> None:
        left, right = match_arm(own, other)
        for side, mine, hits in (("ref", own, left), ("cand", other, right)):
            for pos, text, _, _ in mine:
                place, score = hits.get(pos, (None, None))
                out.append((record, arm, side, pos, text, place, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, own, arm, other, out = object(), [], None, [], []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in (0, 2, 3, 4)]
            types = [kinds[0], kinds[1], pa.string(), kinds[2], kinds[3], kinds[2], pa.float64()]
            for r, is_own, a, pos, text, words, phrases in zip(*(c.to_pylist() for c in batch.columns)):
                if r != record or (not is_own and a != arm):
                    if own and other:
                        settle(record, own, arm, other, out)
                    other = []
                    if r != record:
                        record, own = r, []
                    arm = None if is_own else a
                (own if is_own else other).append((pos, text, frozenset(words or ()), frozenset(phrases or ())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if own and other:
            settle(record, own, arm, other, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = (f"record_id {kind['record_id']}, arm string, side string, pos {kind['pos']}, text string, "
              f"other_pos {kind['pos']}, score double")
    return dealt_by(keyed, "record_id").sortWithinPartitions("record_id", F.desc("own"), "arm", "pos").mapInArrow(run, schema)


def match_by_rounds(facts: DataFrame, reference: str) -> DataFrame:
    """`match_facts` by joins only, for records whose facts are too many for one task.

    Candidates share a word that a pair above the threshold must share (prefix filter, rarest words
    first), or a phrase. "Left facts in order, each takes its best free partner" is the stable
    matching in which every right fact prefers the earliest left fact, so it is reached by rounds of
    proposals; a right fact that holds a left fact drops all later ones at once.
    """
    keyed = facts.select("record_id", "arm", "pos", "text",
                         claim_words("text").alias("words"), claim_phrases("text").alias("phrases"))
    arms = keyed.filter(F.col("arm") != reference).select("record_id", "arm").distinct()
    left = keyed.filter(F.col("arm") == reference).drop("arm").join(arms, "record_id")
    held = left.select("record_id").distinct()
    right = keyed.filter(F.col("arm") != reference).join(held, "record_id", "left_semi")
    left, right = cut_lineage(left), cut_lineage(right)
    key = ["record_id", "arm"]

    def ordered_words(side: DataFrame, name: str) -> DataFrame:
        return side.select(*key, F.col("pos").alias(name), F.size("words").alias("n"), F.explode("words").alias("w"))

    lw, rw = ordered_words(left, "l"), ordered_words(right, "r")
    freq = lw.select(*key, "w").unionByName(rw.select(*key, "w")).groupBy(*key, "w").agg(
        F.count(F.lit(1)).alias("df"))

    def prefix(side: DataFrame, name: str, share: float) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*key, name).orderBy("df", "w"))
        keep = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
        return (side.join(freq, [*key, "w"]).withColumn("p", rank).filter(F.col("p") <= keep)
                .select(*key, name, "w"))

    phrase = lambda side, name: side.select(*key, F.col("pos").alias(name), F.explode("phrases").alias("w"))
    joined = [
        prefix(lw, "l", K.CLAIM_MATCH_THRESHOLD).join(rw.select(*key, "r", "w"), [*key, "w"]),
        prefix(rw, "r", K.CLAIM_CONTAINMENT).join(lw.select(*key, "l", "w"), [*key, "w"]),
        phrase(left, "l").join(phrase(right, "r"), [*key, "w"])]
    ids = joined[0].select(*key, "l", "r")
    for other in joined[1:]:
        ids = ids.unionByName(other.select(*key, "l", "r"))
    scored = (ids.distinct()
              .join(left.select(*key, F.col("pos").alias("l"), F.col("words").alias("wa"),
                                F.col("phrases").alias("fa")), [*key, "l"])
              .join(right.select(*key, F.col("pos").alias("r"), F.col("words").alias("wb"),
                                 F.col("phrases").alias("fb")), [*key, "r"])
              .select(*key, "l", "r", claim_score(F.col("wa"), F.col("fa"), F.col("wb"), F.col("fb")).alias("score"))
              .filter(F.col("score") >= K.CLAIM_MATCH_THRESHOLD))
    candidates = cut_lineage(scored)
    # Left facts of equal wording want the same partners: the n-th of them starts with its n-th choice, which is the best it
    # can get, so repeats cost no round each.
    nth = F.row_number().over(Window.partitionBy(*key, F.xxhash64(F.array_sort("words"), F.array_sort("phrases"))).orderBy("pos"))
    choice = F.row_number().over(Window.partitionBy(*key, "l").orderBy(F.desc("score"), "r"))
    first = candidates.withColumn("choice", choice).join(left.select(*key, F.col("pos").alias("l"), nth.alias("nth")), [*key, "l"]) \
        .filter("choice = nth").groupBy(*key, "r").agg(F.min("l").alias("holder"))
    candidates = cut_lineage(candidates.join(first, [*key, "r"], "left").filter("holder IS NULL OR l <= holder").drop("holder"))

    while True:
        best = candidates.groupBy(*key, "l").agg(F.min(F.struct((-F.col("score")).alias("neg"), "r")).alias("b")) \
            .select(*key, "l", F.col("b.r").alias("r"), (-F.col("b.neg")).alias("score"))
        best = cut_lineage(best)
        holders = best.groupBy(*key, "r").agg(F.min("l").alias("holder"))
        if best.join(holders, [*key, "r"]).filter("l > holder").isEmpty():
            break
        candidates = cut_lineage(
            candidates.join(holders, [*key, "r"], "left").filter("holder IS NULL OR l <= holder").drop("holder"))

    # facts without any word match each other only, in order
    def empties(side: DataFrame, name: str) -> DataFrame:
        bare = side.filter(F.size("words") == 0).withColumn("_block", F.expr("pos div 100000"))
        return running_rank(bare, key, ["_block"], ["pos"], "k").select(*key, "k", F.col("pos").alias(name))

    wordless = empties(left, "l").join(empties(right, "r"), [*key, "k"]).select(
        *key, "l", "r", F.lit(1.0).alias("score"))
    matched = best.unionByName(wordless)
    mine = left.select(*key, F.lit("ref").alias("side"), "pos", "text").join(
        matched.select(*key, F.col("l").alias("pos"), F.col("r").alias("other_pos"), "score"), [*key, "pos"], "left")
    theirs = right.select(*key, F.lit("cand").alias("side"), "pos", "text").join(
        matched.select(*key, F.col("r").alias("pos"), F.col("l").alias("other_pos"), "score"), [*key, "pos"], "left")
    return mine.unionByName(theirs).select(*key, "side", "pos", "text", "other_pos", "score")


# --- what matching is used for -----------------------------------------------
def agreement_counts(matched: DataFrame, by: list[str]) -> DataFrame:
    """shared / only_ref / only_cand of `match_facts` rows, per `by`."""
    free = F.col("other_pos").isNull()
    return matched.groupBy(*by).agg(
        F.count_if((F.col("side") == "ref") & ~free).alias("shared"),
        F.count_if((F.col("side") == "ref") & free).alias("only_ref"),
        F.count_if((F.col("side") == "cand") & free).alias("only_cand"))


def arm_agreement(variants: DataFrame, matched: DataFrame, reference: str) -> DataFrame:
    """Per candidate arm, over records that have both arms: agreement and facts missed/added per record.

    variants(record_id, arm) lists stored variants, also those without facts.
    """
    stored = variants.select("record_id", "arm").distinct()
    both = (stored.filter(F.col("arm") != reference)
            .join(stored.filter(F.col("arm") == reference).select("record_id"), "record_id", "left_semi"))
    per_arm = both.groupBy("arm").agg(F.count(F.lit(1)).alias("records"))
    counts = agreement_counts(matched, ["arm"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    board = per_arm.join(counts, "arm", "left").select(
        "arm", "records", zero("shared"), zero("only_ref"), zero("only_cand"))
    total = F.col("shared") + F.col("only_ref") + F.col("only_cand")
    return board.select(
        "*", F.try_divide("shared", total).alias("agreement"),
        F.try_divide("only_ref", "records").alias("missed_per_record"),
        F.try_divide("only_cand", "records").alias("added_per_record"))


def _stated(chosen: DataFrame) -> DataFrame:
    """facts(record_id, arm, pos, text) of rows (id, fa, fb): arm `ref` states fa, `cand` states fb."""
    sides = F.array(F.struct(F.lit("ref").alias("arm"), F.coalesce("fa", F.array().cast("array<string>")).alias("f")),
                    F.struct(F.lit("cand").alias("arm"), F.coalesce("fb", F.array().cast("array<string>")).alias("f")))
    return chosen.select(F.col("id").alias("record_id"), F.explode(sides).alias("s")).select(
        "record_id", "s.arm", F.posexplode("s.f").alias("pos", "text"))


def diff_of(chosen: DataFrame) -> DataFrame:
    """(id, diff) of rows (id, fa, fb): struct(shared(a, b, score), only_a, only_b), each in the facts' order; the lists hold what
    the record states. Records in which one side states nothing keep the other side's facts."""
    facts = _stated(chosen)
    both = facts.groupBy("record_id").agg(F.count_distinct("arm").alias("n")).filter("n = 2").select("record_id")
    matched = match_facts(facts, "ref").drop("arm").withColumnRenamed("side", "arm")
    alone = facts.join(both, "record_id", "left_anti").select(
        "record_id", "arm", "pos", "text", F.lit(None).cast("int").alias("other_pos"), F.lit(None).cast("double").alias("score"))
    rows = matched.select(*alone.columns).unionByName(alone)
    mate = rows.filter("arm = 'cand' AND other_pos IS NOT NULL").select("record_id", F.col("other_pos").alias("pos"), F.col("text").alias("mate"))
    seen = rows.join(mate.withColumn("arm", F.lit("ref")), ["record_id", "arm", "pos"], "left")
    mine, lonely = F.col("arm") == "ref", F.col("other_pos").isNull()
    listed = lambda when, *cols: F.sort_array(F.collect_list(F.when(when, F.struct("pos", *cols))))
    lists = seen.groupBy("record_id").agg(listed(mine & ~lonely, "text", "mate", "score").alias("s"), listed(mine & lonely, "text").alias("a"),
                                          listed(~mine & lonely, "text").alias("b"))
    diff = F.struct(
        F.transform("s", lambda x: F.struct(x["text"].alias("a"), x["mate"].alias("b"), x["score"].alias("score"))).alias("shared"),
        F.transform("a", lambda x: x["text"]).alias("only_a"), F.transform("b", lambda x: x["text"]).alias("only_b"))
    return lists.select(F.col("record_id").alias("id"), diff.alias("diff"))


NO_DIFF = "struct<shared:array<struct<a:string,b:string,score:double>>,only_a:array<string>,only_b:array<string>>"


def with_diff(chosen: DataFrame) -> DataFrame:
    """Adds `diff` to rows (id, fa, fb, …); empty lists where neither side states anything."""
    none = F.from_json(F.lit('{"shared": [], "only_a": [], "only_b": []}'), NO_DIFF)
    return chosen.join(diff_of(chosen), "id", "left").withColumn("diff", F.coalesce("diff", none)).drop("fa", "fb")


def two_arm_diffs(records: DataFrame) -> DataFrame:
    """(id, a, b, diff) of records that store exactly two variants."""
    arms = F.map_keys("variants")
    facts = lambda c: F.transform(c["facts"], lambda f: f["text"])
    two = records.filter(F.size("variants") == 2).select(
        "id", arms[0].alias("a"), arms[1].alias("b"),
        facts(F.map_values("variants")[0]).alias("fa"), facts(F.map_values("variants")[1]).alias("fb"))
    return with_diff(two)


def avg_disagreement(diffs: DataFrame) -> DataFrame:
    """Mean share of unmatched facts over diffs(shared, only_a, only_b counts); null when there are none."""
    lonely = F.col("only_a") + F.col("only_b")
    return diffs.agg(F.avg(F.try_divide(lonely.cast("double"), (lonely + F.col("shared")).cast("double")))
                     .alias("avg_disagreement"))


def default_arms(records: DataFrame, reference: str = K.REFERENCE_ARM, a: str = "", b: str = "") -> DataFrame:
    """Adds `a` and `b`, the arms a stored diff compares.

    Asked-for arms when stored; else the reference (or first by name) and the next other by name.
    """
    names = F.array_sort(F.map_keys("variants"))
    first = (F.when(F.array_contains(names, a), F.lit(a))
             .when(F.array_contains(names, reference), F.lit(reference))
             .otherwise(F.get(names, F.lit(0))))
    out = records.withColumn("a", first)
    others = F.filter(names, lambda n: n != F.col("a"))
    return out.withColumn("b", F.when(F.array_contains(others, b), F.lit(b)).otherwise(F.get(others, F.lit(0))))


def variants_diff(records: DataFrame, reference: str = K.REFERENCE_ARM, a: str = "", b: str = "") -> DataFrame:
    """Stored-variant diff of every record: (id, available, a, b, diff); null diff when one arm is missing."""
    facts = lambda arm: F.transform(F.try_element_at("variants", arm)["facts"], lambda f: f["text"])
    chosen = default_arms(records, reference, a, b).select(
        "id", F.array_sort(F.map_keys("variants")).alias("available"), "a", "b",
        facts(F.col("a")).alias("fa"), facts(F.col("b")).alias("fb"))
    return with_diff(chosen).select("id", "available", "a", "b",
                      F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("diff")).alias("diff"))


def disagreement_examples(matched: DataFrame, summaries: DataFrame, reference: str, limit: int = 40,
                          chars: int = 400, per_side: int = 6) -> DataFrame:
    """Interleaved examples per arm: both summaries and the first unmatched facts of each side.

    summaries(record_id, arm, summary). Each side's facts are cut to `per_side` before collecting.
    """
    lonely = matched.filter(F.col("other_pos").isNull())
    first = top_n_per_group(lonely, ["record_id", "arm", "side"], ["pos"], per_side)
    per = first.groupBy("record_id", "arm").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "ref", F.struct("pos", "text")))).alias("_r"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "cand", F.struct("pos", "text")))).alias("_c"))
    short = summaries.select("record_id", "arm", F.substring(F.coalesce("summary", F.lit("")), 1, chars).alias("s"))
    shown = (per.join(short.filter(F.col("arm") == reference)
                      .select("record_id", F.col("s").alias("reference_summary")), "record_id", "left")
             .join(short.withColumnRenamed("s", "candidate_summary"), ["record_id", "arm"], "left")
             .select(F.col("record_id").alias("id"), "arm", "reference_summary", "candidate_summary",
                     F.transform("_r", lambda f: f["text"]).alias("only_reference"),
                     F.transform("_c", lambda f: f["text"]).alias("only_candidate")))
    return round_robin(shown, limit)
