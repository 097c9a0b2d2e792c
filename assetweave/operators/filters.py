"""Filters: what sources let through, and what a viewer asks for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.functions import taxonomy as tx
from assetweave.functions.exprs import finite, literal_map, trimmed


def price_sane(price: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """Null and non-finite prices pass."""
    return ~finite(price) | price.between(low, high)


def elig_listings(rows: DataFrame, tokenized: bool = True) -> DataFrame:
    """Classified rows (category, price): stablecoins of sane price, and tokenized assets where asked for."""
    stable = (F.col("category") == "Stablecoin") & price_sane(F.col("price"))
    return rows.where(stable | (F.col("category") == "Tokenized Asset")) if tokenized else rows.where(stable)


def elig_supply_metrics(rows: DataFrame) -> DataFrame:
    """Rows (symbol, name, tags) that have both texts and look like a stable currency."""
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t).contains("stable") | F.lower(t).contains("currency"))
    named = F.col("symbol").rlike(f"(?i){tx.KNOWN_STABLE}") | F.col("name").rlike(f"(?i){tx.KNOWN_STABLE}")
    return rows.where((F.col("symbol") != "") & (F.col("name") != "") & (tagged | named))


def elig_chain_supply(rows: DataFrame, excluded_pegs: tuple[str, ...] = (), excluded_symbols: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """Rows (symbol, name, peg_type, price, circulating, circulating_usd) that are no derived tokens."""
    name = F.col("name")
    upper = F.upper("symbol")
    derived = name.rlike(tx.DERIVED_NAMES) | upper.rlike(tx.DERIVED_NAMES) | name.rlike(r"^w[A-Z]+\z")
    where = (F.col("symbol") != "") & (name != "") & F.col("circulating").isNotNull() & ~derived
    if excluded_pegs:
        where &= ~F.coalesce(F.trim("peg_type").isin(*excluded_pegs), F.lit(False))
    if excluded_symbols:
        where &= ~upper.isin(*[s.upper() for s in excluded_symbols])
    where &= (F.coalesce("peg_type", F.lit("")) != "peggedUSD") | price_sane(F.col("price"))
    where &= ~finite("circulating_usd") | (F.col("circulating_usd") >= least)
    return rows.where(where)


def elig_chain_supply_strict(rows: DataFrame, least_mcap: float, most_rows: int = 200) -> DataFrame:
    """Also a floor of market cap, a stable word in the name, and the largest rows only."""
    kept = elig_chain_supply(rows).where((F.col("mcap") >= least_mcap) & (F.col("name").rlike("(?i)usd|dollar|stable|eur|euro") | F.col("symbol").rlike("(?i)usd|dollar|stable|eur|euro")))
    return kept.orderBy(F.col("mcap").desc(), "key").limit(most_rows)


def elig_markets(rows: DataFrame, least_mcap: float = 1e6) -> DataFrame:
    return rows.where(F.col("price").between(0.5, 2.0) & (F.col("mcap") >= least_mcap))


def fiat_backed(peg: Column) -> Column:
    """Null pegs count as fiat."""
    upper = F.upper(trimmed(peg))
    return peg.isNull() | (upper == "") | upper.isin(tx.ISO_CODES) | F.coalesce(F.try_element_at(literal_map(tx.CURRENCY_ALIASES), upper).isin(tx.ISO_CODES), F.lit(False))


#: Classes of pegs in a viewer's filter; what is in none is 'other'.
PEG_CLASSES = {
    "fiat": ["usd", "eur", "gbp", "jpy", "cny", "cad", "aud", "chf", "sek", "nok", "dkk"],
    "commodities": ["gold", "xau", "silver", "xag", "oil", "platinum"],
    "crypto": ["btc", "eth", "bitcoin", "ethereum"],
    "tokenized": ["etf", "stocks", "realestate", "treasurybills", "commodities", "tokenizedasset", "rwa"],
}


def peg_class(peg: Column) -> Column:
    low = F.lower(F.coalesce(peg, F.lit("")))
    return F.coalesce(*[F.when(low.isin(v), k) for k, v in PEG_CLASSES.items()], F.lit("other"))


def in_range(amount: Column, low: float, high: float, log: bool = False) -> Column:
    """Inclusive; on the logarithmic scale amounts of 0 and less count as 1."""
    if not log:
        return amount.between(low, high)
    import math

    return F.when(amount > 0, F.log10(F.when(amount > 0, amount).otherwise(1.0))).otherwise(0.0).between(math.log10(max(low, 0.001)), math.log10(high))


@dataclass
class Filters:
    """A viewer's choices; what is None isn't filtered."""

    classes: list[str] | None = None
    price: tuple[float, float] | None = None
    mcap_millions: tuple[float, float] | None = None
    mcap_log: bool = False
    volume_thousands: tuple[float, float] | None = None
    volume_log: bool = False
    least_platforms: int = 0
    cross_chain: bool = False
    platforms: list[str] = field(default_factory=list)
    hide_conflicts: bool = False
    complete: bool = False
    search: str = ""

    def condition(self) -> Column:
        """All choices as one condition on rows (peg, price, mcap, volume, platforms, conflicted, name, symbol)."""
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        n = F.coalesce(F.size("platforms"), F.lit(0))
        parts = [F.lit(True)]
        if self.classes is not None:
            parts.append(peg_class(F.col("peg")).isin(*self.classes))
        if self.price:
            parts.append(zero("price").between(*self.price))
        if self.mcap_millions:
            parts.append(in_range(zero("mcap") / 1e6, *self.mcap_millions, self.mcap_log))
        if self.volume_thousands:
            parts.append(in_range(zero("volume") / 1e3, *self.volume_thousands, self.volume_log))
        if self.least_platforms:
            parts.append(n >= self.least_platforms)
        if self.cross_chain:
            parts.append(n >= 2)
        if self.platforms:
            parts.append(F.arrays_overlap("platforms", F.array(*[F.lit(p) for p in self.platforms])))
        if self.hide_conflicts:
            parts.append(~F.col("conflicted"))
        if self.complete:
            parts.append((zero("price") > 0) & (zero("mcap") > 0) & (zero("volume") > 0) & (n > 0))
        if self.search:
            q = self.search.lower()
            parts.append(F.lower(F.coalesce("name", F.lit(""))).contains(q) | F.lower(F.coalesce("symbol", F.lit(""))).contains(q))
        out = parts[0]
        for p in parts[1:]:
            out &= p
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.condition())


def market_data_valid() -> Column:
    return F.coalesce((F.col("price") > 0) & (F.col("mcap") > 0), F.lit(False))


def supply_data_valid() -> Column:
    return F.coalesce(F.col("circulating") > 0, F.lit(False))
