"""Word lists, symbols, unit factors and limits that results depend on."""

# --- fixed values: spellings of "no value" (compared after lower-casing) ---
NULL_LIKES = ["null", "none", "na", "n/a", "nan", "-", ""]

# --- fixed values: characters stripped from both ends of a text ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: currency symbol to code, in the order they are looked for ---
SYMBOL_CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}

# --- fixed values: symbols and codes that mark a money-looking value ---
MONEY_SYMBOLS = "$€£¥₩₹฿₺₽"
MONEY_CODES = [
    "USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "KRW", "THB", "TRY", "RUB",
]

# --- fixed values: symbol shown in front of an amount ---
DISPLAY_SYMBOLS = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹", "CAD": "C$", "AUD": "A$",
    "CHF": "CHF", "CNY": "¥", "KRW": "₩", "THB": "฿", "TRY": "₺", "RUB": "₽",
}

# --- fixed values: unit -> (standard unit, factor, offset); None = kept as written ---
UNITS = {
    "kg": ("kg", 1.0, 0.0),
    "g": ("kg", 0.001, 0.0),
    "mg": ("kg", 0.000001, 0.0),
    "lb": ("kg", 0.453592, 0.0),
    "lbs": ("kg", 0.453592, 0.0),
    "oz": ("kg", 0.0283495, 0.0),
    "t": ("kg", 1000.0, 0.0),
    "ton": ("kg", 1000.0, 0.0),
    "tons": ("kg", 1000.0, 0.0),
    "m": ("m", 1.0, 0.0),
    "km": ("m", 1000.0, 0.0),
    "cm": ("m", 0.01, 0.0),
    "mm": ("m", 0.001, 0.0),
    "ft": ("m", 0.3048, 0.0),
    "in": ("m", 0.0254, 0.0),
    "mi": ("m", 1609.344, 0.0),
    "yd": ("m", 0.9144, 0.0),
    "l": ("L", 1.0, 0.0),
    "ml": ("L", 0.001, 0.0),
    "gal": ("L", 3.78541, 0.0),
    "qt": ("L", 0.946353, 0.0),
    "pt": ("L", 0.473176, 0.0),
    "°c": ("°C", 1.0, 0.0),
    "°f": ("°C", 5.0 / 9.0, -160.0 / 9.0),
    "c": ("°C", 1.0, 0.0),
    "f": ("°C", 5.0 / 9.0, -160.0 / 9.0),
    "k": ("°C", 1.0, -273.15),
    "mph": ("m/s", 0.44704, 0.0),
    "kph": ("m/s", 1.0 / 3.6, 0.0),
    "m/s": ("m/s", 1.0, 0.0),
    "sq": None,
    "sq m": None,
    "sq ft": None,
    "sqm": None,
    "sqft": None,
}

# --- fixed values: where a header's camel case is split, and what joins its words ---
CAMEL_HUMPS = [r"([A-Z]+)([A-Z][a-z])", r"([a-z\d])([A-Z])"]
NOT_A_WORD = r"(?U)[^\w]+"

# --- fixed values: words that carry no meaning as keywords ---
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below", "between", "out",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "because",
    "but", "and", "or", "if", "while", "about", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "it", "its", "i", "me", "my", "myself", "we", "our", "ours", "you",
    "your", "yours", "he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs",
    "tell", "show", "find", "get", "give", "know", "think", "say", "make", "go", "see", "come",
    "take", "want", "look", "use", "many", "much",
]

# --- fixed values: words that tell what a question asks for ---
MAX_WORDS = ["most", "highest", "max", "maximum", "largest", "top"]
MIN_WORDS = ["least", "lowest", "min", "minimum", "smallest", "fewest"]
SUM_WORDS = ["sum", "total"]
AVERAGE_WORDS = ["average", "avg", "mean"]
COUNT_WORDS = ["count", "many", "number"]
METRIC_WORDS = [
    "amount", "sale", "total", "box", "ship", "qty", "quantity", "count", "number", "price",
    "cost", "revenue", "volume",
]

# --- fixed values: roles a question can ask about, and the column words that serve them ---
ROLE_QUESTION_WORDS = {
    "person": ["who", "seller", "sold", "sale", "salesperson", "sales", "person", "name"],
    "product": ["product", "item", "sku", "brand", "flavor"],
    "location": ["where", "country", "region", "market", "city", "state", "location"],
    "date": ["when", "date", "day", "month", "year", "time"],
}
ROLE_COLUMN_WORDS = {
    "person": [
        "sale", "sales", "salesperson", "seller", "person", "name", "rep", "agent", "employee",
        "staff", "owner",
    ],
    "product": ["product", "item", "sku", "brand", "flavor"],
    "location": ["country", "region", "market", "city", "state", "location"],
    "date": ["date", "day", "month", "year", "time"],
}

# --- fixed values: order in which tied type votes are settled (later wins) ---
TYPE_PRIORITY = ["unknown", "text", "number", "date", "measurement", "money"]

# --- fixed values: sample sizes and limits ---
MEASUREMENT_SHARE = 0.8
NUMERIC_SHARE = 0.4
SORT_SHARE = 0.6
NAME_LENGTH = 64
DESCRIPTION_LENGTH = 100
FOLDER_NAME_LENGTH = 255
TOP_N_LIMIT = 20
EMBEDDING_WIDTH = 384
MAX_FILE_BYTES = 50 * 1024 * 1024
SNIFF_BYTES = 65536
HEADER_SNIFF_BYTES = 256 * 1024
