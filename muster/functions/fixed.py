"""Word lists and tables of fixed values."""

from __future__ import annotations

# Function words.
FUNCTION_WORDS = """a all also an and any are as at be been but
by can do down even every for from had has have
her his if in into is it its may more must my
no not now of on one only or our shall should
so some such than that the their then there things
this to up upon was were what when which who will
with would your""".split()

# Words typical of generated text.
GENERATED_WORDS = """delve tapestry leverage navigate foster embark underscore
showcase streamline facilitate elucidate realm landscape
framework ecosystem cornerstone paradigm robust seamless
intricate nuanced pivotal crucial vital comprehensive
holistic innovative transformative""".split()

# Discourse markers.
DISCOURSE_MARKERS = """however therefore moreover furthermore additionally indeed
thus hence consequently nevertheless nonetheless accordingly""".split()

# Punctuation marks counted.
MARKS = list(".,;:!?—-\"'")

# Entity registry, in order: name, sector, type, lobbying intensity.
REGISTRY = [
    ("american bankers association", "banking", "trade_assoc", "very_high"),
    ("credit union national association", "banking", "trade_assoc", "very_high"),
    ("cuna", "banking", "trade_assoc", "very_high"),
    ("national association of federal credit unions", "banking", "trade_assoc", "very_high"),
    ("consumer bankers association", "banking", "trade_assoc", "high"),
    ("independent community bankers of america", "banking", "trade_assoc", "very_high"),
    ("icba", "banking", "trade_assoc", "very_high"),
    ("financial services forum", "banking", "trade_assoc", "very_high"),
    ("investment company institute", "asset_mgmt", "trade_assoc", "very_high"),
    ("ici", "asset_mgmt", "trade_assoc", "very_high"),
    ("sifma", "securities", "trade_assoc", "very_high"),
    ("securities industry and financial markets association", "securities", "trade_assoc", "very_high"),
    ("mortgage bankers association", "mortgage", "trade_assoc", "high"),
    ("national association of realtors", "real_estate", "trade_assoc", "very_high"),
    ("national association of mortgage brokers", "mortgage", "trade_assoc", "high"),
    ("american financial services association", "finance", "trade_assoc", "high"),
    ("consumer data industry association", "data", "trade_assoc", "high"),
    ("national consumer law center", "consumer_advocacy", "advocacy", "high"),
    ("americans for financial reform", "consumer_advocacy", "advocacy", "high"),
    ("center for responsible lending", "consumer_advocacy", "advocacy", "high"),
    ("consumer federation of america", "consumer_advocacy", "advocacy", "high"),
    ("american petroleum institute", "energy", "trade_assoc", "very_high"),
    ("api", "energy", "trade_assoc", "very_high"),
    ("edison electric institute", "energy", "trade_assoc", "very_high"),
    ("natural resources defense council", "environment", "advocacy", "high"),
    ("nrdc", "environment", "advocacy", "high"),
    ("sierra club", "environment", "advocacy", "high"),
    ("environmental defense fund", "environment", "advocacy", "high"),
    ("phrma", "pharma", "trade_assoc", "very_high"),
    ("pharmaceutical research and manufacturers of america", "pharma", "trade_assoc", "very_high"),
    ("american medical association", "healthcare", "trade_assoc", "very_high"),
    ("ama", "healthcare", "trade_assoc", "very_high"),
    ("american hospital association", "healthcare", "trade_assoc", "very_high"),
    ("aha", "healthcare", "trade_assoc", "very_high"),
    ("computer and communications industry association", "tech", "trade_assoc", "high"),
    ("ccia", "tech", "trade_assoc", "high"),
    ("internet association", "tech", "trade_assoc", "high"),
    ("techfreedom", "tech", "advocacy", "medium"),
    ("us chamber of commerce", "general", "trade_assoc", "very_high"),
    ("chamber of commerce of the united states", "general", "trade_assoc", "very_high"),
    ("national association of manufacturers", "general", "trade_assoc", "very_high"),
    ("nam", "general", "trade_assoc", "very_high"),
]

# Legal forms and the article that a normalised organisation goes without.
LEGAL_FORMS = ["inc", "llc", "llp", "corp", "corporation", "ltd", "limited", "co", "company", "the"]

# Campaigns of the synthetic corpus: label, comments, day, hour, minutes of the burst, forced state, organisation.
CAMPAIGNS = [
    ("industry_template_a", 600, 14, 2, 47, "VI", "Internet & Television Association"),
    ("lead_gen_firm_b", 500, 21, 14, 72, None, "American Bankers Association"),
    ("bot_network_c", 400, 30, 3, 8, None, None),
    ("student_script_d", 200, 25, 23, 60, "MA", None),
]

# Weights of the signals in the cluster score, and its two limits.
WEIGHTS = {"duplicate": 0.20, "temporal_coupling": 0.15, "stylometric": 0.25, "argument_identity": 0.20, "ai_detection": 0.15, "paraphrase_reachable": 0.05}
CAMPAIGN, UNCERTAIN = 0.40, 0.28
# Weights of the coordination edges; seconds within which two comments are timed together.
TIMING, TEMPLATE, METADATA, EDGE_LIMIT, TOGETHER_S = 0.4, 0.4, 0.2, 0.1, 60
