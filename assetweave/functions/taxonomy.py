"""Fixed values that results depend on: codes, aliases, tags, name rules."""

# Currency codes.
ISO_CODES = """
USD EUR GBP JPY CHF CAD AUD NZD SEK NOK DKK PLN CZK HUF RON BGN HRK RUB TRY CNY
HKD SGD KRW THB MYR IDR PHP VND INR PKR LKR BDT NPR MMK LAK KHR AED SAR QAR KWD
BHD OMR JOD ILS EGP LBP SYP IQD IRR AFN BRL ARS CLP COP PEN UYU PYG BOB VES GYD
ZAR NGN GHS KES UGX TZS RWF ETB XOF XAF MAD TND DZD LYD SDG SSP DJF SOS ERN
MXN GTQ HNL NIO CRC PAB JMD HTG DOP CUP XCD BBD BZD TTD SRD FKP AWG ANG BMD
KYD BSD ZWD ZWL BWP SZL LSL MZN MWK ZMW AOA STN CVE GMD GNF LRD SLE MRU CDF XDR
""".split()

# What a peg code or symbol stands for.
CURRENCY_ALIASES = {
    "XAU": "Gold", "XAG": "Silver", "XAUT": "Gold", "PAXG": "Gold", "GOLD": "Gold", "SILVER": "Silver",
    "XDR": "Special Drawing Rights", "SDR": "Special Drawing Rights",
    "DOLLAR": "USD", "EURO": "EUR", "POUND": "GBP", "YEN": "JPY", "YUAN": "CNY", "RENMINBI": "CNY", "FRANC": "CHF", "RUPEE": "INR",
    "WON": "KRW", "REAL": "BRL", "PESO": "MXN", "RAND": "ZAR", "RUBLE": "RUB", "ROUBLE": "RUB", "LIRA": "TRY",
    "USDT": "USD", "USDC": "USD", "BUSD": "USD", "USDP": "USD", "TUSD": "USD", "FDUSD": "USD", "PYUSD": "USD",
    "EURC": "EUR", "EURS": "EUR", "EURT": "EUR", "CEUR": "EUR", "STASIS": "EUR", "GBPT": "GBP", "QCAD": "CAD", "CADC": "CAD",
    "AUDX": "AUD", "NZDS": "NZD", "JPYC": "JPY", "CNHT": "CNY", "IDRT": "IDR", "BIDR": "IDR", "THBX": "THB", "BRLT": "BRL",
    "INRT": "INR", "KRWT": "KRW", "ZZAR": "ZAR", "XSGD": "SGD",
}

# Words of names that mean a currency, in the order in which they are tried.
CURRENCY_NAMES = [
    ("USD", "dollar|usd"), ("EUR", "euro|eur"), ("GBP", "pound|sterling|gbp"), ("JPY", "yen|jpy"), ("CNY", "yuan|renminbi|cny"),
    ("CHF", "franc|chf"), ("CAD", r"canadian\s+dollar|cad"), ("AUD", r"australian\s+dollar|aud"), ("INR", "rupee|inr"), ("BRL", "real|brl"),
    ("RUB", "ruble|rouble|rub"), ("KRW", "won|krw"), ("ZAR", "rand|zar"), ("TRY", "lira|try"), ("MXN", "peso|mxn"),
]

# Tags.
STABLE_TAGS = ["stablecoin"]
TOKENIZED_TAGS = ["tokenized-assets"]
ASSET_BACKED_TAGS = ["asset-backed-stablecoin"]
TOKENIZED_SUBTYPES = [
    ("tokenized-gold", "Gold"), ("tokenized-silver", "Silver"), ("tokenized-etfs", "ETF"), ("tokenized-stock", "Stocks"),
    ("tokenized-real-estate", "Real Estate"), ("tokenized-treasury-bills", "Treasury Bills"), ("tokenized-commodities", "Commodities"),
]

# Patterns of symbols and names.
GOLD_SYMBOLS, GOLD_NAMES, SILVER_SYMBOLS, SILVER_NAMES = "xau|paxg|xaut", "gold", "xag", "silver"
ETF, TREASURY, STOCK, ESTATE = "etf", "treasury", "stock", "real estate|real-estate|estate"
KNOWN_STABLE = "usdt|usdc|dai|busd|frax|usdd|tusd|pax|gusd|husd|stable|dollar|usd"
DERIVED_NAMES = "(?i:wrapped|liquid|staked|yield|reward|pool|vault|interest|synthetic)"

# Names of platforms.
PLATFORM_ALIASES = {
    "ethereum-pow-ecosystem": "Ethereum", "ethereum": "Ethereum", "eth": "Ethereum", "tron20-ecosystem": "Tron", "tron": "Tron", "trx": "Tron",
    "binance-smart-chain": "BSC", "bsc": "BSC", "bnb": "BSC", "binance": "BSC", "polygon": "Polygon", "matic": "Polygon", "solana": "Solana",
    "sol": "Solana", "avalanche": "Avalanche", "avax": "Avalanche", "arbitrum": "Arbitrum", "optimism": "Optimism", "base": "Base",
    "bitcoin": "Bitcoin", "btc": "Bitcoin", "omni": "Bitcoin (Omni)", "stellar": "Stellar", "xlm": "Stellar", "algorand": "Algorand",
    "algo": "Algorand", "cardano": "Cardano", "ada": "Cardano", "near": "NEAR", "flow": "Flow", "hedera": "Hedera", "sui": "Sui",
    "aptos": "Aptos", "manta": "Manta", "thundercore": "ThunderCore", "ton": "TON", "cronos": "Cronos", "mantle": "Mantle", "linea": "Linea",
    "scroll": "Scroll", "blast": "Blast", "zksync": "zkSync Era", "fantom": "Fantom", "ftm": "Fantom", "celo": "Celo", "harmony": "Harmony",
    "moonbeam": "Moonbeam", "moonriver": "Moonriver", "kava": "Kava", "osmosis": "Osmosis", "terra": "Terra", "injective": "Injective",
    "cosmos": "Cosmos Hub", "juno": "Juno", "evmos": "Evmos",
}
PLATFORM_CONTAINS = [
    ("ethereum", "Ethereum"), ("tron", "Tron"), ("binance", "BSC"), ("bsc", "BSC"), ("polygon", "Polygon"), ("matic", "Polygon"),
    ("solana", "Solana"), ("avalanche", "Avalanche"), ("avax", "Avalanche"), ("arbitrum", "Arbitrum"), ("optimism", "Optimism"),
    ("bitcoin", "Bitcoin"), ("btc", "Bitcoin"), ("fantom", "Fantom"), ("ftm", "Fantom"), ("zksync", "zkSync Era"), ("cosmos", "Cosmos Hub"),
]

# Sources, with the priority of a merge and that of a conflict of classes.
SOURCES = [("cmc", 10), ("messari", 8), ("coingecko", 6), ("defillama", 4)]
CLASS_PRIORITY = {"cmc": 10, "messari": 9, "defillama": 8, "coingecko": 6}

# Fields that a source's records should have.
EXPECTED_FIELDS = {
    "cmc": {"required": ["symbol", "name", "id"], "optional": ["tags", "slug", "marketData", "metadata"], "types": {"symbol": "string", "name": "string", "id": "number", "tags": "array", "slug": "string"}},
    "messari": {"required": ["symbol", "name"], "optional": ["tags", "slug", "supplyData", "metadata"], "types": {"symbol": "string", "name": "string", "tags": "array"}},
    "coingecko": {"required": ["symbol", "name", "id"], "optional": ["tags", "categories", "platforms"], "types": {"symbol": "string", "name": "string", "id": "string", "categories": "array"}},
    "defillama": {"required": ["symbol", "name"], "optional": ["tags", "pegged", "pegType", "chainCirculating"], "types": {"symbol": "string", "name": "string", "pegged": "string", "chainCirculating": "object"}},
}
