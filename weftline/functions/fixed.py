"""Tables, patterns and thresholds that results depend on. Stated as they are, not derived."""

# Brahmic scripts share one layout: values are offsets in a block of 128 code points.
INDIC_FIRST, INDIC_LAST = 0x0900, 0x0D7F
VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li",
}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "f", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "g",
    0x5B: "z", 0x5C: "d", 0x5D: "dh", 0x5E: "f", 0x5F: "y",
}
VOWEL_SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li",
}
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA = 0x4D
FIRST_DIGIT, LAST_DIGIT = 0x66, 0x6F

# Letters that decomposition leaves as they are.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "Æ": "AE", "Œ": "OE", "Ø": "O", "Ł": "L", "Đ": "D", "’": "'", "‘": "'", "–": "-", "—": "-"}

# Digits and signs typed for letters.
LOOKALIKE_FROM, LOOKALIKE_TO = "0134578@$|", "oleastbasl"
ORDINAL = r"^\d+(st|nd|rd|th|er|e|eme|bis|ter|[a-z])?$"
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co\.in|fr|us|biz|info|co)\b"
ALIAS = r"\b(?:aka|a/k/a|dba|d/b/a|fka|f/k/a|t/a|trading as|doing business as)\b"
NO_VALUE = r"<null>|\bnull\b|\bnone\b|\bn/?a\b"

# Abbreviations in names.
NAME_WORDS = {
    "pvt": "private", "pvtltd": "private limited", "prvt": "private", "priv": "private", "ltd": "limited",
    "ltda": "limited", "lmtd": "limited", "limted": "limited", "corp": "corporation", "corpn": "corporation",
    "co": "company", "cos": "company", "inc": "incorporated", "incorp": "incorporated", "incorporation": "incorporated",
    "intl": "international", "int": "international", "mfg": "manufacturing", "assn": "association",
    "assoc": "association", "bros": "brothers", "svcs": "services", "svc": "services", "ent": "enterprises",
    "ents": "enterprises", "enterprise": "enterprises", "mgmt": "management", "tech": "technologies",
    "technology": "technologies", "dev": "development", "grp": "group", "ctr": "center", "centre": "center",
    "et": "and", "st": "saint", "ste": "saint", "sainte": "saint", "elaelapi": "llp", "elelpi": "llp", "elalpi": "llp",
    "ets": "etablissements", "cie": "compagnie", "soc": "societe",
}
# Words of a name that carry no identity: legal forms, honorifics, filler, countries, parts of web addresses.
LEGAL = frozenset(
    "private limited incorporated corporation company llc llp lp pllc plc pc pa ltd gmbh ag nv bv sarl sas sasu eurl sa sci snc scs scop selarl "
    "and the of de du des la le les d l et a an aka dba fka ta m s ms mr mrs dr smt shri sri shree sree opc india france usa us com www net org co".split()
)
NOT_A_FORM = frozenset("and the of a an".split())
MORE_LEGAL = frozenset("ei eirl scm gie sel selas sca".split())

# Abbreviations in addresses, and city names that changed.
ADDRESS_WORDS = {
    "street": "st", "str": "st", "saint": "st", "sainte": "st", "ste": "st", "stree": "st", "road": "rd", "avenue": "ave",
    "av": "ave", "aven": "ave", "anenue": "ave", "drive": "dr", "boulevard": "blvd", "bd": "blvd", "bld": "blvd",
    "lane": "ln", "court": "ct", "place": "pl", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "terrace": "ter",
    "square": "sq", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw",
    "southeast": "se", "southwest": "sw", "trail": "trl", "way": "way", "mount": "mt", "fort": "ft", "point": "pt",
    "county": "cnty", "suite": "unit", "apartment": "unit", "apt": "unit", "rue": "r", "allee": "all", "impasse": "imp",
    "chemin": "ch", "route": "rte", "nagar": "ngr", "colony": "col", "sector": "sec", "near": "nr", "opposite": "opp",
    "opp": "opp", "building": "bldg", "floor": "flr", "number": "no", "num": "no", "house": "h", "plot": "plot",
    "village": "vill", "vpo": "vill", "district": "dist", "dt": "dist", "tehsil": "teh",
    "bombay": "mumbai", "poona": "pune", "madras": "chennai", "calcutta": "kolkata", "bengaluru": "bangalore",
    "gurugram": "gurgaon", "baroda": "vadodara", "cochin": "kochi", "mysuru": "mysore",
    "trivandrum": "thiruvananthapuram", "benares": "varanasi", "banaras": "varanasi", "allahabad": "prayagraj",
    "cawnpore": "kanpur", "belgaum": "belagavi",
}
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
}
IN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg",
    "chattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh",
    "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml",
    "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk",
    "tamil nadu": "tn", "tamilnadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up",
    "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk",
    "jammu kashmir": "jk", "ladakh": "la", "puducherry": "py", "pondicherry": "py", "chandigarh": "ch",
    "andaman and nicobar islands": "an", "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld",
}
# Address words that are no blocking key.
ADDRESS_STOP = (
    "st rd ave dr blvd ln ct pl unit no the and of de du des la le nr opp flr floor road near box cnty city door shop office plot bldg sec vill dist".split()
)

# Blocking: document frequencies, numbers of keys and of candidates.
MOST_DF, PROBES, TOP_PROBE = 500, 16, 60
NAME_MOST_DF, NAME_PROBES, TOP_NAME = 2000, 5, 10
RAREST_NAME, RAREST_ADDRESS, RAREST_NUMBER, RAREST_IN_PAIRS = 3, 4, 3, 4
NAME_KINDS = ("n", "c", "k", "m")
PRUNE_RANK, PRUNE_SHARE, PRUNE_MUTUAL = 10, 0.3, 2
STAGE_TWO_TOP, STAGE_TWO_LEAST, PASS_ONE_LEAST, PASS_TWO_LEAST = 8, 0.0881, 0.75, 0.70
SURE, SIBLING_PROBE, SIBLING_TOP, SIBLING_TOP_LATER, SIBLING_LEAST = 0.9, 30, 4, 2, 0.5
# Ids of the sources start at 0, here and here.
SECOND_SOURCE, THIRD_SOURCE = 100_000_000, 200_000_000
PSEUDO_LOW, PSEUDO_HIGH, PSEUDO_WEIGHT, GATE_DROP = 0.03, 0.97, 0.5, 0.0005
