"""Mentions linked to entities: context rules, listed aliases, scored candidates, and decoding of whole windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A mention in lower case, an expression for its context, and the entity meant there; the first that fits holds.
CONTEXT_RULES = (
    ("turing", r"(?i)\b(?:universal\s+)?turing\s+machines?\b|\buniversal\s+turing\b|\bnon-?deterministic\s+turing\b|\bprobabilistic\s+turing\b", "Q163310"),
    ("turing", r"(?i)\bturing\s+award\b", "Q185667"),
    ("turing", r"(?i)\balan\s+turing\b|\balan\s+mathison\s+turing\b|\balan\s+m\.?\s*turing\b|\bturing\s*[(,]", "Q7251"),
    ("图灵", "图灵机", "Q163310"),
)
MAX_CANDIDATES = 15
CANDIDATES_BY_LANGUAGE = 10
MIN_SCORE = 0.14
#: Aliases are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_ALIASES = 200_000


def context_override(mention, context, rules=CONTEXT_RULES) -> Column:
    """The entity that a rule gives the mention in its context, or null."""
    m = F.lower(F.trim(F.col(mention) if isinstance(mention, str) else mention))
    c = F.coalesce(F.col(context) if isinstance(context, str) else context, F.lit(""))
    out = F.lit(None).cast("string")
    for name, rx, qid in reversed(rules):
        out = F.when((m == name) & c.rlike(rx), qid).otherwise(out)
    return out


def aliases(entity_map: DataFrame) -> DataFrame:
    """alias (lower case, stripped), qid: of lines with one alias the last one holds."""
    rows = entity_map.select("line_no", T.strip(F.lower("alias")).alias("alias"), F.regexp_replace("wikidata_id", r"\s+", "").alias("qid"))
    rows = rows.filter((F.coalesce("alias", F.lit("")) != "") & (F.coalesce("qid", F.lit("")) != ""))
    return rows.groupBy("alias").agg(F.max_by("qid", "line_no").alias("qid"), F.max("line_no").alias("line_no"))


def kinds(entity_map: DataFrame) -> DataFrame:
    """qid, kind: the first that isn't empty."""
    rows = entity_map.select("line_no", F.regexp_replace("wikidata_id", r"\s+", "").alias("qid"), F.trim("kind").alias("kind"))
    rows = rows.filter((F.coalesce("qid", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != ""))
    return rows.groupBy("qid").agg(F.min_by("kind", "line_no").alias("kind"))


def alias_override(mentions: DataFrame, listed: DataFrame) -> DataFrame:
    """mention, qid, alias: the longest listed alias of two characters or more that the mention contains.

    Containment is found by equality: every pair of neighbouring characters of a mention meets the aliases that begin
    with it, and what stands there is compared. Distinct mentions are joined once.
    """
    once = mentions.select("mention").filter("mention is not null").distinct()
    low = F.lower("mention")
    last = F.length(low) - 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    pairs = once.select("mention", F.explode(starts).alias("at")).withColumn("head", F.substring(low, F.col("at"), F.lit(2)))
    known = listed.filter(F.length("alias") >= 2).withColumn("head", F.substring("alias", 1, 2))
    hint = F.broadcast if known.count() <= BROADCAST_ALIASES else (lambda d: d)
    met = pairs.join(hint(known), "head").filter(F.substring(low, F.col("at"), F.length("alias")) == F.col("alias"))
    return met.groupBy("mention").agg(F.min(F.struct((-F.length("alias")).alias("minus"), "line_no", "qid", "alias")).alias("b")).select("mention", "b.qid", "b.alias")


def candidates(found: DataFrame) -> DataFrame:
    """mention, ord, id, label, description: the results of each language's search in the order of languages, each
    entity once, at most MAX_CANDIDATES. found: mention, lang_ord, rank, id, label, description."""
    near = found.filter(F.col("rank") < CANDIDATES_BY_LANGUAGE)
    first = near.groupBy("mention", "id").agg(F.min(F.struct("lang_ord", "rank", "label", "description")).alias("f"))
    order = Window.partitionBy("mention").orderBy("f.lang_ord", "f.rank", "id")
    return first.withColumn("ord", F.row_number().over(order) - 1).filter(F.col("ord") < MAX_CANDIDATES).select("mention", "ord", "id", F.col("f.label").alias("label"), F.col("f.description").alias("description"))


def search(mentions: DataFrame, listed: DataFrame, limit: int = CANDIDATES_BY_LANGUAGE) -> DataFrame:
    """mention, id, label, rank: the limit most relevant entities for each distinct mention, of all listed aliases that
    begin as it does (two characters). An entity counts once, by the alias that fits best: by label, then by n-grams."""
    once = mentions.select("mention").filter(F.length("mention") >= 2).distinct()
    m = F.lower(F.trim("mention"))
    sized = once.withColumns({"head": F.lower(F.substring("mention", 1, 2)), "_m": T.char_ngrams("mention")})
    known = listed.filter(F.length("alias") >= 2).select(F.substring("alias", 1, 2).alias("head"), F.col("qid").alias("id"), F.col("alias").alias("label"), T.char_ngrams("alias").alias("_l"))
    fit = F.when(F.col("label") == m, 0).when(F.contains("label", m), 1).otherwise(2)
    met = sized.join(known, "head").withColumns({"fit": fit, "minus": -T.set_jaccard("_m", "_l")})
    best = met.groupBy("mention", "id").agg(F.min(F.struct("fit", "minus", "label")).alias("f"))
    order = Window.partitionBy("mention").orderBy("f.fit", "f.minus", "f.label", "id")
    return best.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < limit).select("mention", "id", F.col("f.label").alias("label"), "rank")


def with_mention_sets(mentions: DataFrame) -> DataFrame:
    """mentions in context with their words and n-grams, which are worked out once, before candidates join them."""
    return mentions.withColumns({"_context": T.tokens(F.coalesce("context", F.lit(""))), "_m": T.char_ngrams("mention")})


def with_candidate_sets(candidates_: DataFrame) -> DataFrame:
    lab = F.coalesce(F.trim("label"), F.lit(""))
    return candidates_.withColumns({"_said": T.tokens(F.concat_ws(" ", lab, F.coalesce("description", F.lit("")))), "_l": T.char_ngrams(lab)})


def scored(pairs: DataFrame, breakdown: bool = False) -> DataFrame:
    """pairs of mentions in context and candidates (mention, context, id, label, description, ord), with their score: by
    the label, the words that candidate and context share, the n-grams of mention and label, the place in the list.

    The sets come from with_mention_sets and with_candidate_sets; where they are missing they are worked out here.
    breakdown adds a struct of the parts.
    """
    m, lab = F.lower(F.trim("mention")), F.coalesce(F.trim("label"), F.lit(""))
    sets = pairs.filter(F.col("id").startswith("Q"))
    sets = sets if "_m" in pairs.columns else with_mention_sets(sets)
    sets = sets if "_l" in pairs.columns else with_candidate_sets(sets)
    bonus = F.when(F.lower(lab) == m, 0.4).when((lab != "") & F.contains(F.lower(lab), m), 0.22).otherwise(0.0)
    prior = F.greatest(F.lit(0.0), 0.12 - 0.015 * F.col("ord"))
    parts = sets.withColumns({"_bonus": bonus, "_words": T.set_jaccard("_context", "_said"), "_grams": T.set_jaccard("_m", "_l"), "_prior": prior})
    out = parts.withColumn("score", F.col("_bonus") + 0.55 * F.col("_words") + 0.35 * F.col("_grams") + F.col("_prior"))
    if breakdown:
        exact = (F.lower(lab) == m).alias("label_exact")
        out = out.withColumn("breakdown", F.struct("label", "description", exact, F.col("_words").alias("context_jaccard"), F.col("_grams").alias("char_ngram_jaccard_3"), F.col("_prior").alias("position_prior"), F.col("_bonus").alias("label_bonus")))
    return out.drop("_context", "_said", "_m", "_l", "_bonus", "_words", "_grams", "_prior")


def accepted(rows: DataFrame, keys: list[str], min_score: float = MIN_SCORE) -> DataFrame:
    """The best candidate of each mention: where it scores enough, or is the only one."""
    best = rows.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord", "id")).alias("b"), F.countDistinct("id").alias("n"))
    return best.select(*keys, F.when((-F.col("b.minus") >= min_score) | (F.col("n") == 1), F.col("b.id")).alias("qid"), (-F.col("b.minus")).alias("score"), "n")


OVERRIDE = "struct<matched_key:string,qid:string,source:string>"
SCORES = "array<struct<qid:string,score:double,breakdown:struct<label:string,description:string,label_exact:boolean,context_jaccard:double,char_ngram_jaccard_3:double,position_prior:double,label_bonus:double>>>"


def audited(mentions: DataFrame, listed: DataFrame, min_score: float = MIN_SCORE, rules=CONTEXT_RULES, limit: int = CANDIDATES_BY_LANGUAGE) -> DataFrame:
    """One row for each mention in context with what led to its entity: chosen_qid, chosen_score, override_hit (a context
    rule, or a listed alias that the mention contains), and candidate_scores, best first, with the parts of each score.

    mentions: mention, context. listed: alias, qid, line_no. A listed alias ends the search, so such a mention has no
    candidate scores and takes no part in joint decoding; mentions of fewer than two characters have nothing.
    """
    pairs = mentions.select("mention", "context").filter("mention is not null").distinct()
    long = pairs.filter(F.length(F.trim("mention")) >= 2)
    ruled = long.withColumn("rule", context_override("mention", "context", rules))
    by_alias = alias_override(long, listed).select("mention", F.col("qid").alias("alias_qid"), "alias")
    known = ruled.join(by_alias, "mention", "left")
    open_ = known.filter("rule is null and alias_qid is null").select("mention", "context")
    hits = search(open_, listed, limit).select("mention", "id", "label", F.col("rank").alias("ord"), F.lit("").alias("description"))
    each = scored(with_mention_sets(open_).join(with_candidate_sets(hits), "mention"), breakdown=True)
    best = each.groupBy("mention", "context").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ord", F.col("id").alias("qid"), "score", "breakdown"))).alias("all"))
    found = best.select(F.col("mention").alias("m"), F.col("context").alias("c"), F.transform("all", lambda c: F.struct(c["qid"].alias("qid"), c["score"].alias("score"), c["breakdown"].alias("breakdown"))).cast(SCORES).alias("found"))
    both = known.join(found, [F.col("mention") == F.col("m"), F.col("context").eqNullSafe(F.col("c"))], "left").drop("m", "c")
    top = F.get("found", F.lit(0))
    enough = F.when((top["score"] >= min_score) | (F.size("found") == 1), top["qid"])
    text = lambda x: F.lit(x).cast("string")
    empty = F.struct(text("").alias("label"), text("").alias("description"), F.lit(None).cast("boolean").alias("label_exact"), *[F.lit(None).cast("double").alias(c) for c in ("context_jaccard", "char_ngram_jaccard_3", "position_prior", "label_bonus")])
    hit = F.when(F.col("rule").isNotNull(), F.struct(F.col("mention").alias("matched_key"), F.col("rule").alias("qid"), text("context_disambiguation").alias("source"))).when(F.col("alias_qid").isNotNull(), F.struct(F.col("alias").alias("matched_key"), F.col("alias_qid").alias("qid"), text("entity_map").alias("source")))
    sure = F.coalesce("rule", "alias_qid")
    rows = both.select(
        "mention", "context", F.coalesce(sure, enough).alias("chosen_qid"), F.when(sure.isNotNull(), 1.0).otherwise(F.coalesce(top["score"], F.lit(0.0))).alias("chosen_score"), hit.cast(OVERRIDE).alias("override_hit"),
        F.when(F.col("rule").isNotNull(), F.array(F.struct(F.col("rule").alias("qid"), F.lit(1.0).alias("score"), empty.alias("breakdown")))).otherwise(F.coalesce("found", F.array().cast(SCORES))).cast(SCORES).alias("candidate_scores"),
    )
    none = pairs.filter(F.length(F.trim("mention")) < 2).select("mention", "context", text(None).alias("chosen_qid"), F.lit(0.0).alias("chosen_score"), F.lit(None).cast(OVERRIDE).alias("override_hit"), F.array().cast(SCORES).alias("candidate_scores"))
    return rows.unionByName(none)


def neighbour_sets(claims: DataFrame, qids: DataFrame, props: list[str]) -> DataFrame:
    """qid, near: the targets of an entity's claims of the given properties. claims: subject, prop_id, target_qid."""
    wanted = claims.filter(F.col("prop_id").isin(props) & F.col("target_qid").isNotNull())
    return wanted.join(qids.select(F.col("qid").alias("subject")).distinct(), "subject", "left_semi").groupBy(F.col("subject").alias("qid")).agg(F.sort_array(F.collect_set("target_qid")).alias("near"))


def coherence(a, b) -> Column:
    """Jaccard similarity of two neighbour sets; 0 where one is empty or missing."""
    x, y = F.coalesce(F.col(a), F.array().cast("array<string>")), F.coalesce(F.col(b), F.array().cast("array<string>"))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


DECODED = "source_id string, seed_id string, sentence_idx int, mention string, qid string, local double, coherence double, total double, changed_from string"


def decode_window(nodes: list[dict], near: dict[str, set], weight: float, sweeps: int = 3) -> list[dict]:
    """Coordinate ascent over the nodes of one window: each in turn takes the candidate that is best beside the others'
    present choices; it ends when a sweep changes nothing. nodes: candidates as (qid, local score), in order."""

    def fit(q1: str, q2: str) -> float:
        a, b = near.get(q1, set()), near.get(q2, set())
        return 0.0 if q1 == q2 or not a or not b else len(a & b) / len(a | b)

    chosen = [max(range(len(n["cands"])), key=lambda k, n=n: (n["cands"][k][1], -k)) for n in nodes]
    start = list(chosen)

    def value(i: int, k: int) -> float:
        qid, local = nodes[i]["cands"][k]
        return local + weight * sum(fit(qid, nodes[j]["cands"][chosen[j]][0]) for j in range(len(nodes)) if j != i)

    for _ in range(sweeps):
        moved = False
        for i, n in enumerate(nodes):
            best, top = chosen[i], value(i, chosen[i])
            for k in range(len(n["cands"])):
                v = value(i, k)
                if v > top + 1e-9:
                    best, top = k, v
            if best != chosen[i]:
                chosen[i], moved = best, True
        if not moved:
            break
    out = []
    for i, n in enumerate(nodes):
        qid, local = n["cands"][chosen[i]]
        total = value(i, chosen[i])
        before = n["cands"][start[i]][0]
        out.append({"qid": qid, "local": local, "coherence": total - local, "total": total, "changed_from": before if before != qid else None})
    return out


def collective(nodes: DataFrame, near: DataFrame, window: int = 2, top: int = 6, weight: float = 0.35, block: int = 128) -> DataFrame:
    """Joint choice of the entities of mentions close together in a source. nodes: source_id, seed_id, sentence_idx,
    mention, cands (array of struct<qid, score>, best first).

    Every index of a source is the centre of a window; a mention keeps what the last window over it gave. Sources are
    cut into blocks of sentence indexes, each with what lies within reach on both sides, so no task gets a whole source.
    """
    best = F.slice("cands", 1, top)
    rows = nodes.filter(F.size("cands") > 0).select("source_id", "seed_id", "sentence_idx", "mention", best.alias("cands"))
    each = rows.select("*", F.explode("cands").alias("c")).join(near.withColumnRenamed("qid", "c_qid"), F.col("c.qid") == F.col("c_qid"), "left")
    full = each.groupBy("source_id", "seed_id", "sentence_idx", "mention").agg(F.sort_array(F.collect_set(F.struct((-F.col("c.score")).alias("minus"), F.col("c.qid").alias("qid"), F.coalesce("near", F.array().cast("array<string>")).alias("near")))).alias("cands"))
    reach = 2 * window
    home = F.floor(F.col("sentence_idx") / block)
    blocks = F.array_distinct(F.array(F.floor((F.col("sentence_idx") - reach) / block), home, F.floor((F.col("sentence_idx") + reach) / block)))
    placed = full.withColumn("block", F.explode(blocks))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["sentence_idx"], r["mention"]))
        block_no = rows[0]["block"]
        near_sets: dict[str, set] = {}
        for r in rows:
            r["cands"] = [(c["qid"], -c["minus"], c["near"]) for c in r["cands"]]
            for qid, _, targets in r["cands"]:
                near_sets[qid] = set(targets)
            r["cands"] = [(q, s) for q, s, _ in r["cands"]]
        done: dict[int, dict] = {}
        for center in sorted({r["sentence_idx"] for r in rows}):
            inside = [k for k, r in enumerate(rows) if abs(r["sentence_idx"] - center) <= window]
            if len(inside) < 2:
                continue
            for k, choice in zip(inside, decode_window([rows[k] for k in inside], near_sets, weight), strict=True):
                done[k] = choice
        out = []
        for k, r in enumerate(rows):
            if r["sentence_idx"] // block == block_no:
                alone = {"qid": r["cands"][0][0], "local": r["cands"][0][1], "coherence": 0.0, "total": r["cands"][0][1], "changed_from": None}
                out.append({key: r[key] for key in ("source_id", "seed_id", "sentence_idx", "mention")} | done.get(k, alone))
        names = [f.split()[0] for f in DECODED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        return pa.table({n: pa.array([o[n] for o in out], k) for n, k in zip(names, kinds, strict=True)})

    return placed.withColumn("sentence_idx", F.col("sentence_idx").cast("int")).groupBy("source_id", "seed_id", "block").applyInArrow(run, DECODED)


def resolved_rows(mentions: DataFrame, links: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions with the entity chosen: the joint choice where there is one, else the link; literals have none."""
    both = mentions.join(links, keys, "left").join(decoded.select(*keys, F.col("qid").alias("d_qid"), F.col("total").alias("d_total"), "coherence"), keys, "left")
    literal = F.col("ner_label").isin("DATE", "TIME", "MONEY", "PERCENT")
    qid = F.when(literal, "").otherwise(F.coalesce("d_qid", "qid", F.lit("")))
    source = F.when(literal, "literal_no_wikidata_link").when(F.col("d_qid").isNotNull(), "collective").otherwise("existing_pipeline")
    scores = F.struct(F.coalesce("score", F.lit(0.0)).alias("local"), F.coalesce("coherence", F.lit(0.0)).alias("global"), F.coalesce("d_total", "score", F.lit(0.0)).alias("total"))
    return both.select(*mentions.columns, qid.alias("chosen_qid"), scores.alias("scores"), source.alias("source"))
