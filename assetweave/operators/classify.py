"""The rule classifier over a table of assets, its statistics, conflicts between sources and checks of schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetweave.functions import taxonomy as tx
from assetweave.functions.exprs import literal_map

#: Longest name, symbol or slug.
MOST_CHARS = 500


def _any(tags: Column, names: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in names]))


class Taxonomy:
    """Tags and currencies of the rules; extra ones come on top of the fixed ones."""

    def __init__(self, stable_tags: list[str] | None = None, tokenized_tags: list[str] | None = None, currencies: dict[str, str] | None = None):
        self.stable = tx.STABLE_TAGS + [t.lower() for t in stable_tags or []]
        self.tokenized = tx.TOKENIZED_TAGS + [t.lower() for t in tokenized_tags or []]
        self.codes = tx.ISO_CODES + [c.upper() for c in currencies or {}]
        self.names = tx.CURRENCY_NAMES + [(c.upper(), n.lower()) for c, n in (currencies or {}).items()]

    @property
    def aliases(self) -> Column:
        return literal_map(tx.CURRENCY_ALIASES)

    def alias(self, code: Column) -> Column:
        return F.coalesce(F.try_element_at(self.aliases, code), code)

    def _known(self, code: Column) -> Column:
        upper = F.upper(code)
        return F.when(upper.isin(self.codes), self.alias(upper))

    def category(self, tags: Column) -> Column:
        subtypes = [t for t, _ in tx.TOKENIZED_SUBTYPES]
        stable = _any(tags, self.stable) | F.exists(tags, lambda t: t.rlike(r"^([a-z]{3}-stablecoin|pegged[a-z0-9]+)\z"))
        return F.when(stable, "Stablecoin").when(_any(tags, self.tokenized) | _any(tags, subtypes), "Tokenized Asset").otherwise("Other")

    def currency(self, symbol: Column, name: Column, slug: Column) -> Column:
        """The currency that an asset's symbol or name tells; all in lower case."""
        extract = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
        by_symbol = self._known(extract(symbol, r"^([a-z]{3})(?:[tc]|[-_](?:token|coin|t))?\z"))
        # one look for all names first; few rows have any
        text = F.concat_ws("\n", name, slug)
        names = [(code, rf"\b(?:{p})\b") for code, p in self.names]
        by_name = F.when(text.rlike(rf"\b(?:{'|'.join(p for _, p in self.names)})\b"), F.coalesce(*[F.when(text.rlike(p), self.alias(F.lit(code))) for code, p in names]))
        prefix = self._known(F.coalesce(extract(symbol, r"^([a-z]{3})[tc]?\z"), extract(symbol, r"^([a-z]{3})[-_]")))
        x_prefix = self._known(extract(symbol, r"^x([a-z]{3})\z"))
        word = self._known(extract(F.concat_ws(" ", name, slug), r"\b([a-z]{3})\b"))
        return F.coalesce(F.try_element_at(self.aliases, F.upper(symbol)), by_symbol, by_name, prefix, x_prefix, word)

    def metal(self, symbol: Column, name: Column, slug: Column) -> Column:
        gold = symbol.rlike(tx.GOLD_SYMBOLS) | F.concat_ws("\n", name, slug).rlike(tx.GOLD_NAMES)
        silver = symbol.rlike(tx.SILVER_SYMBOLS) | F.concat_ws("\n", name, slug).rlike(tx.SILVER_NAMES)
        return F.when(gold, "Gold").when(silver, "Silver")

    def commodity(self, tags: Column, symbol: Column, name: Column, slug: Column) -> Column:
        tagged = F.when(F.array_contains(tags, "tokenized-gold"), "Gold")
        gold = F.when(self.metal(symbol, name, slug) == "Gold", "Gold")
        silver = F.when(F.array_contains(tags, "tokenized-silver"), "Silver")
        return F.coalesce(tagged, gold, silver, self.metal(symbol, name, slug), F.lit("Commodities"))

    def tokenized_type(self, symbol: Column, name: Column, slug: Column, metal: Column | None = None) -> Column:
        of = lambda p, label: F.when(F.concat_ws("\n", name, slug).rlike(p), label)
        return F.coalesce(self.metal(symbol, name, slug) if metal is None else metal, of(tx.ETF, "ETF"), of(tx.TREASURY, "Treasury Bills"), of(tx.STOCK, "Stocks"), of(tx.ESTATE, "Real Estate"), F.lit("Tokenized Asset"))

    def asset_backed(self, symbol: Column, name: Column, slug: Column) -> Column:
        return F.coalesce(self.currency(symbol, name, slug), F.nullif(self.tokenized_type(symbol, name, slug), F.lit("Tokenized Asset")))

    def peg(self, tags: Column, symbol: Column, category: Column, currency: Column, metal: Column, kind: Column) -> Column:
        """What the asset is pegged to or stands for, of its currency, metal and tokenized type, each worked out once."""
        first = lambda pattern: F.get(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, pattern, 1)), lambda c: c != ""), F.lit(0))
        backed = F.when(_any(tags, tx.ASSET_BACKED_TAGS), F.coalesce(currency, F.nullif(kind, F.lit("Tokenized Asset"))))
        stable = F.coalesce(self.alias(F.upper(first(r"^([a-z]{3})-stablecoin\z"))), self.alias(F.upper(first(r"^pegged([a-z0-9]+)\z"))), currency, backed)
        tagged = lambda tag, label: F.when(F.array_contains(tags, tag), label)
        commodity = F.coalesce(tagged("tokenized-gold", "Gold"), F.when(metal == "Gold", "Gold"), tagged("tokenized-silver", "Silver"), metal, F.lit("Commodities"))
        subtype = F.coalesce(*[tagged(t, commodity if label == "Commodities" else label) for t, label in tx.TOKENIZED_SUBTYPES])
        inferred = F.when(_any(tags, self.tokenized), kind)
        return F.when(category == "Stablecoin", stable).otherwise(F.coalesce(subtype, inferred, backed))


def classify(assets: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """assets (tags, name, symbol, slug) with category and peg_found. Case doesn't count."""
    t = taxonomy or Taxonomy()
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = assets.withColumns({"_tags": F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(F.coalesce(x, F.lit("")))), "_symbol": lower("symbol"), "_name": lower("name"), "_slug": lower("slug")})
    texts = F.col("_symbol"), F.col("_name"), F.col("_slug")
    rows = rows.withColumn("category", t.category(F.col("_tags")))
    rows = rows.withColumns({"_metal": t.metal(*texts), "_currency": t.currency(*texts), "_backed": _any(F.col("_tags"), tx.ASSET_BACKED_TAGS)})
    rows = rows.withColumn("_kind", F.when((F.col("category") != "Stablecoin") | F.col("_backed"), t.tokenized_type(*texts, F.col("_metal"))))
    rows = rows.withColumn("peg_found", t.peg(F.col("_tags"), F.col("_symbol"), F.col("category"), F.col("_currency"), F.col("_metal"), F.col("_kind")))
    return rows.drop("_tags", "_symbol", "_name", "_slug", "_metal", "_currency", "_backed", "_kind")


def input_valid() -> Column:
    """Whether a row may be classified: no text is too long, and there are tags."""
    return F.coalesce(*[F.when(F.length(c) > MOST_CHARS, False) for c in ("name", "symbol", "slug")], F.col("tags").isNotNull())


def stats(classified: DataFrame) -> DataFrame:
    """(by, value, n): rows in all, by source and by category."""
    sets = classified.groupingSets([[], ["source"], ["category"]], "source", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("category").alias("by"), F.coalesce("source", "category", F.lit("all")).alias("value"), "n")


def unknown_patterns(classified: DataFrame) -> DataFrame:
    """(pattern, n): the first five tags, in order, of rows that no rule knows."""
    return classified.where((F.col("category") == "Other") & (F.size("tags") > 0)).groupBy(F.array_join(F.array_sort(F.slice("tags", 1, 5)), "|").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def newest_per_key(rows: DataFrame, keep: int = 5) -> DataFrame:
    """The newest entries of each asset_key; ties to the first-seen source."""
    w = Window.partitionBy("asset_key").orderBy(F.col("ts").desc(), "seq")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def class_conflicts(rows: DataFrame) -> DataFrame:
    """asset_keys whose sources differ in category, peg or both. rows: asset_key, source, category, peg."""
    got = newest_per_key(rows).groupBy("asset_key").agg(F.count(F.lit(1)).alias("n_sources"), F.countDistinct("category").alias("n_categories"), F.countDistinct(F.coalesce("peg", F.lit("none"))).alias("n_pegs"))
    kind = F.when((F.col("n_categories") > 1) & (F.col("n_pegs") > 1), "mixed").when(F.col("n_categories") > 1, "category").when(F.col("n_pegs") > 1, "peggedAsset")
    return got.withColumn("conflict", kind).where("conflict IS NOT NULL")


def resolved(rows: DataFrame, how: str) -> DataFrame:
    """(asset_key, category, peg) chosen by priority, specificity or newest; ties to the first seen."""
    ranks = {
        "priority": F.coalesce(F.try_element_at(F.create_map(*[x for k, v in tx.CLASS_PRIORITY.items() for x in (F.lit(k), F.lit(v))]), F.col("source")), F.lit(0)),
        "specific": F.when(F.col("category").isin("Stablecoin", "Tokenized Asset"), 2).otherwise(1) + F.when(F.col("peg").isNotNull(), 1).otherwise(0),
        "newest": F.unix_micros(F.col("ts").cast("timestamp")),
    }
    best = F.max_by(F.struct("category", "peg"), F.struct(ranks[how].cast("long").alias("rank"), (-F.col("seq")).alias("first"))).alias("x")
    return rows.groupBy("asset_key").agg(best).select("asset_key", "x.category", "x.peg")


def resolved_by_consensus(rows: DataFrame) -> DataFrame:
    """(asset_key, category, peg) of most votes, each field by itself; the value seen later wins ties."""

    def votes(field: str) -> DataFrame:
        value = F.coalesce(F.col(field), F.lit("none"))
        counted = rows.groupBy("asset_key", value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
        return counted.groupBy("asset_key").agg(F.nullif(F.max_by("value", F.struct("n", "first")), F.lit("none")).alias(field))

    return votes("category").join(votes("peg"), "asset_key")


def expected_fields(spark) -> DataFrame:
    """(source, field, required, type) of the fields that records should have."""
    rows = [(s, f, f in x["required"], x["types"].get(f)) for s, x in tx.EXPECTED_FIELDS.items() for f in dict.fromkeys([*x["required"], *x["optional"], *x["types"]])]
    return spark.createDataFrame(rows, "source string, field string, required boolean, type string")


def json_fields(raw: DataFrame) -> DataFrame:
    """(source, id, field, type) of the top-level fields of records (source, id, payload as JSON)."""
    v = raw.select("source", "id", F.try_parse_json("payload").alias("v")).where("v IS NOT NULL")
    long = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("v").outer())).select("source", "id", F.col("key").alias("field"), F.schema_of_variant("value").alias("t"))
    kind = F.when(F.col("t").startswith("ARRAY"), "array").when(F.col("t").startswith("OBJECT"), "object").when(F.col("t") == "STRING", "string").when(F.col("t") == "BOOLEAN", "boolean").when(F.col("t") == "VOID", "null").otherwise("number")
    return long.select("source", "id", "field", kind.alias("type"))


def schema_violations(raw: DataFrame) -> DataFrame:
    """(source, id, field, violation): required fields that are missing, other types, fields that nobody expects."""
    fields = json_fields(raw)
    expected = F.broadcast(expected_fields(raw.sparkSession))
    needed = raw.select("source", "id").join(expected.where("required"), "source")
    missing = needed.join(fields.where("type <> 'null'"), ["source", "id", "field"], "left_anti").select("source", "id", "field", F.lit("missing").alias("violation"))
    found = fields.join(expected.select("source", "field", F.col("type").alias("wanted"), F.lit(True).alias("known")), ["source", "field"], "left")
    other = found.where("known AND wanted IS NOT NULL AND type <> 'null' AND type <> wanted").select("source", "id", "field", F.lit("type").alias("violation"))
    unknown = found.where("known IS NULL").select("source", "id", "field", F.lit("unknown").alias("violation"))
    return missing.union(other).union(unknown)


def schema_profile(raw: DataFrame) -> DataFrame:
    """(source, field, type, n) of all records."""
    return json_fields(raw).groupBy("source", "field", "type").agg(F.count(F.lit(1)).alias("n"))


def newest(events: DataFrame, by: str, keep: int, *ties: str) -> DataFrame:
    """The newest rows (ts) of each group."""
    w = Window.partitionBy(by).orderBy(F.col("ts").desc(), *ties)
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def drift_events(violations: DataFrame) -> DataFrame:
    """(source, id, ts, n_violations, n_unknown, attributes): one event for each record with rows (source, id, ts, field,
    violation); attributes are the unknown fields, ten at most."""
    unknown = F.when(F.col("violation") == "unknown", F.col("field"))
    return violations.groupBy("source", "id").agg(F.max("ts").alias("ts"), F.count_if(F.col("violation") != "unknown").alias("n_violations"), F.count(unknown).alias("n_unknown"), F.slice(F.array_sort(F.collect_set(unknown)), 1, 10).alias("attributes"))


def drift_log(violations: DataFrame, records: int = 100, events: int = 25) -> DataFrame:
    """(list, source, id, ts, n_violations, n_unknown, attributes): of each source the newest records with violations, and the
    newest events of any kind. A row number with a limit keeps that many of each task's rows before they are shuffled."""
    found = drift_events(violations)
    broken = newest(found.where("n_violations > 0"), "source", records, "id").withColumn("list", F.lit("violations"))
    return broken.unionByName(newest(found, "source", events, "id").withColumn("list", F.lit("drift")))


def drift_status(violations: DataFrame, hours: int = 24) -> DataFrame:
    """(source, n_violations, n_unknown, status) of events (source, ts, field, violation).

    Violations count in the last hours before the newest event, unknown fields by name; the status is that of all
    sources together.
    """
    now = violations.agg(F.max("ts").alias("now"))
    recent = F.col("ts") > F.col("now") - F.expr(f"INTERVAL {hours} HOURS")
    got = violations.join(F.broadcast(now)).groupBy("source").agg(F.count_if(recent & (F.col("violation") != "unknown")).alias("n_violations"), F.countDistinct(F.when(F.col("violation") == "unknown", F.col("field"))).alias("n_unknown"))
    whole = got.agg(F.sum("n_violations").alias("v"), F.sum("n_unknown").alias("u"))
    status = F.when((F.col("v") > 50) | (F.col("u") > 20), "critical").when((F.col("v") > 10) | (F.col("u") > 5), "degraded").otherwise("healthy")
    return got.join(F.broadcast(whole)).select("source", "n_violations", "n_unknown", status.alias("status"))


def quality_health(summary: DataFrame) -> DataFrame:
    """summary (success_rate, conflict_rate, schema, n_unknown) with score, status and quality."""
    penalty = F.when(F.col("schema") == "critical", 25).when(F.col("schema") == "degraded", 10).otherwise(0)
    score = F.greatest(F.lit(0.0), F.floor(100 - 40 * (1 - F.col("success_rate")) - 30 * F.col("conflict_rate") - penalty + 0.5).cast("double"))
    got = summary.withColumn("score", score)
    worst = (F.col("conflict_rate") > 0.3) | (F.col("schema") == "critical") | (F.col("n_unknown") > 50)
    poor = (F.col("conflict_rate") > 0.1) | (F.col("schema") == "degraded") | (F.col("n_unknown") > 20)
    return got.withColumns({"status": F.when(F.col("score") < 50, "critical").when(F.col("score") < 75, "degraded").otherwise("healthy"), "quality": F.when(worst, "critical").when(poor, "degraded").otherwise("healthy")})


def classifier_alerts(summary: DataFrame) -> DataFrame:
    """(type, level, value): rules that fire on one summary row (success_rate, conflict_rate, n_unknown)."""
    rules = F.array(
        F.struct(F.lit("success_rate").alias("type"), F.when(F.col("success_rate") < 0.5, "critical").otherwise("warning").alias("level"), F.col("success_rate").alias("value"), (F.col("success_rate") < 0.8).alias("fired")),
        F.struct(F.lit("unknown_patterns").alias("type"), F.lit("warning").alias("level"), F.col("n_unknown").cast("double").alias("value"), (F.col("n_unknown") > 20).alias("fired")),
        F.struct(F.lit("conflict_rate").alias("type"), F.when(F.col("conflict_rate") > 0.3, "critical").otherwise("warning").alias("level"), F.col("conflict_rate").alias("value"), (F.col("conflict_rate") > 0.1).alias("fired")),
    )
    return summary.select(F.explode(rules).alias("r")).where("r.fired").select("r.type", "r.level", F.round("r.value", 6).alias("value"))
