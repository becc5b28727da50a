"""Code tables, word lists and thresholds that results depend on."""

# Code prefixes of the master-table rules, tested in this order.
MASTER_PREFIXES = (
    ("main_structure", ("MA", "MW", "SW", "MH", "MF", "DW", "UF", "PM")),
    ("garage", ("AG", "DG", "GBI", "GAR", "CARP")),
    ("deck", ("DECK", "WDK")),
    ("porch", ("POR", "PCH", "ENP", "SUN")),
    ("basement", ("BM",)),
    ("shop", ("SHOP", "GPB")),
    ("shed", ("SH", "SHD", "MSHD", "BU", "MPS")),
    ("pool", ("POOL", "SPL", "SPA", "HOTTUB")),
)

# Code prefixes of the roll rules, tested in this order.
ROLL_PREFIXES = (
    ("garage", ("AG", "DG", "GBI", "GAR", "CARP", "LOFT")),
    ("deck", ("DECK", "CWP", "WDK")),
    ("porch", ("POR", "PCH", "ENP", "SUN")),
    ("basement", ("BM",)),
    ("shop", ("SHOP", "MPS", "GPB")),
    ("shed", ("SH", "SHD", "MSHD", "BU")),
    ("pool", ("POOL", "SPL", "SPA", "HOTTUB")),
)
MAIN_PREFIXES = ("MA", "MW", "SW", "MH", "MF", "DW", "UF", "PM")
MAIN_AREA_PREFIXES = ("MA", "MW", "SW", "MH", "MF", "DW")
HOME_PREFIXES = ("MA", "UF", "SW", "MW", "PM")
FINISHED_BASEMENT_PREFIXES = ("BMF", "BMG")

# Whole codes that bypass the prefix rules.
EXACT_CODES = {
    "ARNA": "outbuilding",
    "BMG": "basement",
    "BML": "basement",
    "BMU": "unfinished_basement",
    "BSMT": "basement",
    "C-S": "outbuilding",
    "CP": "porch",
    "DG1.5": "garage",
    "DG2": "garage",
    "DGAR": "garage",
    "DOCK": "outbuilding",
    "GREENH": "outbuilding",
    "GRNH": "outbuilding",
    "GARFIN": "main_structure",
    "LB-LOFT": "outbuilding",
    "LOFT": "main_structure",
    "LFT": "outbuilding",
    "OFP": "outbuilding",
    "UF1.5F": "main_structure",
    "UF1.5U": "main_structure",
    "UF2": "main_structure",
    "UF2.5F": "main_structure",
    "UF2.5U": "main_structure",
    "UF3": "main_structure",
    "MA": "main_structure",
    "MA1.5": "main_structure",
    "MA2": "main_structure",
    "MA2.5": "main_structure",
    "MA3": "main_structure",
}

# Display category by prefix, first match in this order.
DISPLAY_CATEGORIES = {
    "MA": "home", "MA1.5": "home", "MA2": "home", "MA2.5": "home", "UF": "home",
    "SW": "home", "MW": "home", "PM": "home",
    "AG": "garage", "DG": "garage", "GBI": "garage", "GAR": "garage", "CARP": "garage", "LOFT": "garage",
    "BM": "home",
    "CP": "amenity", "CCP": "amenity", "DECK": "amenity", "CWP": "amenity", "ENP": "amenity",
    "SUN": "amenity", "BBQ": "amenity", "OFP": "amenity", "OS": "amenity",
    "C-S": "outbuilding", "MPS": "outbuilding", "RC": "outbuilding", "LT": "outbuilding", "AR": "outbuilding",
    "BU": "outbuilding", "FD": "outbuilding", "FS": "outbuilding", "GPB": "outbuilding", "GREENH": "outbuilding",
    "HR": "outbuilding", "HS": "outbuilding", "LF": "outbuilding", "LB": "outbuilding", "MSHD": "outbuilding",
    "LAG": "amenity",
    "MCB": "outbuilding", "ML": "outbuilding", "MP": "outbuilding", "PS": "outbuilding", "PLH": "outbuilding",
}

# Display labels of whole codes.
DISPLAY_LABELS = {
    "MA": "Main Area",
    "MA-SPLIT": "Split Entry Home (Upper Floor Area)",
    "MA-TRI": "Tri-Level Home (Main and Upper Floors)",
    "MA1.5F": "1.5 Story Home with Finished Upper Floor",
    "MA1.5U": "1.5 Story Home with Unfinished Upper Floor",
    "MA2": "Two Story Home (Main Level)",
    "MA2.5F": "2.5 Story Home with Finished Top Floor",
    "MA2.5U": "2.5 Story Home with Unfinished Top Floor",
    "UF1.5F": "Finished Upper Level in 1.5 Story Home",
    "UF1.5U": "Unfinished Upper Level in 1.5 Story Home",
    "UF2": "Second Floor Living Area",
    "UF2.5F": "Finished Upper Floor in 2.5 Story Home",
    "UF2.5U": "Unfinished Upper Floor in 2.5 Story Home",
    "AGAR": "Attached Garage (Single Story)",
    "AG1.5": "Attached Garage with Loft or Partial Upper Room",
    "AG2": "Attached Garage with Full Upper Room",
    "DGAR": "Detached Garage (Single Story)",
    "DG1.5": "Detached Garage with Loft or Partial Upper Room",
    "DG2": "Detached Garage with Full Upper Room",
    "GBI": "Built-In Garage (Part of Main Structure)",
    "CARP": "Carport (Open-Sided Shelter)",
    "LOFT": "Loft Above Garage or Outbuilding",
    "GARFIN": "Finished Room Attached to Garage (Rec Room or Apartment)",
    "BMU": "Unfinished Basement",
    "BML": "Basement with Basic or Low-Quality Finish",
    "BMF": "Finished Basement (Similar to Main Living Area)",
    "BMG": "Basement Garage",
    "BMT": "Tri-Level Basement",
    "CP": "Concrete Patio",
    "CCP": "Covered Concrete Patio",
    "DECK": "Wood Deck",
    "CWP": "Covered Wood Deck",
    "ENP": "Enclosed or Covered Porch",
    "SUN": "Sunroom or Glass Solarium",
    "BBQ": "Built-In Barbecue Area",
    "OFP": "Outdoor Fireplace",
    "OS": "Outdoor Sink or Kitchen Feature",
    "C-S": "Cabin or Studio (Guest or Hobby Space)",
    "MPS": "Multi-Purpose Shed or Workshop",
    "RC": "Roof Cover or Shelter",
    "LT": "Lean-To or Open-Sided Shelter",
    "SW": "Single-Wide Manufactured Home",
    "MW": "Double-Wide or Multi-Wide Manufactured Home",
    "PM": "Park Model Home",
    "ARNA": "Indoor or Covered Arena",
    "BUNK": "Bunker or Feed Storage Silo",
    "FDB": "Feeder Barn",
    "FSB": "Free-Stall Barn (Livestock Shelter)",
    "GPB": "General Purpose Barn or Building",
    "GPBFIN": "General Purpose Building with Finished Living Space",
    "GREENH": "Greenhouse",
    "HRC": "Hay Cover or Roofed Storage Area",
    "HSTB": "Hobby Stable or Small Animal Barn",
    "LFT": "Loft Area (Used with Barn or Outbuilding)",
    "LB": "Loft Barn",
    "MSHD": "Machine Shed or Equipment Storage",
    "LAGOON": "Manure Lagoon or Waste Pond",
    "MCB": "Metal Building (Commercial or Agricultural)",
    "MLKB": "Milk Barn",
    "MP": "Milk Parlor",
    "PS": "Potato or Crop Storage Building",
    "PLH": "Poultry Laying House or Chicken Barn",
}
QUALITY_LABELS = {
    "MSL": "Low", "MSF": "Fair", "MSA": "Average", "MSG": "Good", "MSVG": "Very Good", "MSE": "Excellent",
}
CONDITION_LABELS = {
    "E": "Excellent", "VG": "Very Good", "G": "Good", "A": "Average", "F": "Fair", "P": "Poor",
}

# Code scores.
QUALITY_SCORES = {
    "MSE": 6, "MSVG": 5, "MSVG+": 5, "MSG+": 4, "MSG": 4, "MSA": 3, "MSA+": 3, "MSF": 2, "MSL": 1,
}
CONDITION_SCORES = {"E": 6, "VG": 5, "G": 4, "A": 3, "F": 2, "P": 1, "L": 0, "U": 3}
QUALITY_WEIGHTS = {"MSL": 1, "MSF": 2, "MSA": 3, "MSG": 4, "MSVG": 5, "MSE": 6}
CONDITION_ORDER = {"P": 0, "F": 1, "A": 2, "G": 3, "VG": 4, "E": 5}

# Bath tokens (whole tokens of the master rules, of the bath job,
# and bare tokens of the roll rules).
MASTER_BATHS = {
    "FB": 1.0, "MB": 1.0, "BTH": 1.0, "2FB": 2.0, "3FB": 3.0, "QB": 0.75, "3QB": 0.75,
    "HB": 0.5, "2HB": 1.0, "QTR": 0.25,
}
HOME_BATHS = {"MB": 1.0, "FB": 1.0, "2FB": 2.0, "3FB": 3.0, "3QB": 0.75, "HB": 0.5, "2HB": 1.0}
ROLL_BATHS = {
    "MB": 1.0, "FB": 1.0, "QB": 0.75, "HB": 0.5, "BTH": 1.0, "FULL": 1.0, "HALF": 0.5, "QTR": 0.25,
}

# Market areas by hood-code prefix (short and long lists).
AREAS_SHORT = (
    ("BURLINGTON", ("20B", "21B")),
    ("LACONNER_CONWAY", ("20LC", "21LC")),
    ("ANACORTES", ("20A", "21A")),
    ("SEDRO_WOOLLEY", ("20SW", "21SW")),
    ("CONCRETE", ("20CC", "10CC")),
    ("MOUNT_VERNON", ("20MV", "21MV")),
)
AREAS_LONG = (
    ("BURLINGTON", ("20B", "21B", "22B", "23B", "26B", "27B")),
    ("LACONNER_CONWAY", ("20LC", "21LC", "22LC", "23LC", "20CON", "22CON")),
    ("ANACORTES", ("20A", "21A", "22A", "23A", "20FID", "22FID", "20GUEM", "22GUEM")),
    ("SEDRO_WOOLLEY", ("20SW", "21SW", "22SW", "23SW")),
    ("CONCRETE", ("20CC", "22CC", "10CC")),
    ("MOUNT_VERNON", ("20MV", "21MV", "22MV", "23MV")),
)
TREND_PREFIXES = (
    "20MV", "21MV", "22MV", "23MV", "20LC", "21LC", "22LC", "23LC", "20B", "21B", "22B", "23B", "26B", "27B",
    "20A", "21A", "22A", "23A", "20FID", "22FID", "20GUEM", "22GUEM", "20SW", "21SW", "22SW", "23SW",
    "20CC", "22CC", "10CC",
)
VIEW_MARKS = ("WFT", "WATER", "BAY", "SHORE", "FID", "GUEM", "SKY", "MVHILL", "MVHIGH", "MVHILCRE", "MVTBIRD")

# Land-use codes per model mode and of the ratio study.
MODE_LAND_USE = {"sfr": (110, 111, 112, 113), "mobile_home": (180, 181)}
STUDY_LAND_USE = (
    "110", "111", "112", "113", "120", "130", "140", "180", "181", "182", "190", "910", "911", "912",
)

# Placeholder texts.
BLANK_CATEGORIES = ("NAN", "*", "NONE", "N/A")
BLANK_ADDRESSES = ("", "nan", "nan nan, nan", "none", "null", "n/a")
JUNK_ADDRESSES = ("-", "nan", "nan nan", "nan, nan", "nan nan nan", "nan, nan, nan")
BLANK_COUNTS = ("na", "n/a", "none", "", "0")
BLANK_RULES = ("", "NONE", "NULL", "UNKNOWN")

# Page word lists.
MENU_WORDS = (
    "menu", "menus", "food", "eat", "drink", "dining", "dinner", "lunch", "brunch", "breakfast", "appetizers",
    "entrees", "entree", "main", "sides", "desserts", "takeout", "take-out", "order", "pickup", "delivery",
    "carta", "drinks", "beverage", "wine", "beer", "cocktail", "specials", "kids", "children", "catering",
)
OTHER_PAGE_WORDS = (
    "contact", "about", "team", "careers", "jobs", "press", "login", "signup", "register", "cart", "checkout",
    "privacy", "terms", "policy", "subscribe", "newsletter", "blog", "news",
)
PRICE_PATTERN = r"\$?\s*\d+(?:[.,]\d{2})?"
MENU_SCORE_WORDS = ("appetizer", "entree", "dessert", "side")
FOOD_WORDS = ("pizza", "burger", "salad", "chicken", "beef", "fish", "pasta")
NON_CONTENT_TAGS = (
    "script", "style", "noscript", "footer", "header", "nav", "aside", "form", "iframe", "svg", "canvas",
    "video", "audio", "button", "select", "textarea",
)
CHAIN_PATTERNS = (
    r"mcdonald'?s", r"taco\s?bell", r"jack\s?in\s?the\s?box", r"denn(y'?s)?",
    r"burger\s?king", r"subway", r"domino'?s", r"papa\s?john(?:’s)?",
    r"kfc", r"starbucks", r"wendy('?s)?", r"arbys?", r"sonic", r"five\s?guys",
    r"buffalo\s?wild\s?wings", r"chipotle", r"panera", r"little\s?caesars?",
    r"red\s?robin", r"olive\s?garden", r"applebee('?s)?", r"ihop",
    r"wingstop", r"panda\s?express",
    r"taco\s*time", r"ivars?", r"salty('?s)?", r"burgerville", r"dick'?s\s?drive[-\s]?in",
    r"mod\s?pizza",
)
TOKEN_RATES = {"gpt-4o-mini": 0.00015, "gpt-4o": 0.005, "deepseek-chat": 0.0001}
TOKEN_RATE_DEFAULT = 0.0002

# County defaults of zoning rules.
ZONING_DEFAULTS = {
    "min_lot_size_sqft": 43560, "max_lot_coverage_pct": 35, "max_height_ft": 30, "front_setback_ft": 35,
    "side_setback_ft": 8, "rear_setback_ft": 25, "allows_adu": True, "allows_duplex": False,
    "allows_multifamily": False,
}

# Census variables.
CENSUS_VARIABLES = {
    "B19013_001E": "median_income",
    "B15003_022E": "edu_bachelors",
    "B15003_023E": "edu_masters",
    "B15003_024E": "edu_professional",
    "B15003_025E": "edu_doctorate",
    "B01001_001E": "population",
    "B25077_001E": "median_home_value",
    "B25064_001E": "median_rent",
}
CENSUS_MISSING = "-666666666"

# Keys of yearly history records and change percents.
HISTORY_VALUE_KEYS = ("MARKET TOTAL", "LAND MARKET", "ASSESSED TOTAL", "LAND ASSESSED")
CHANGE_KEYS = (
    "assessed_change_pct", "assessment_change_pct", "percent_change", "percentchange", "pct_change",
    "pct change", "change_pct",
)

# Model term lists.
REQUIRED_TERMS = (
    "log_area", "log_lot", "log_age", "t", "quality_score", "condition_score", "has_garage", "has_basement", "is_view",
)
IGNORED_TERMS = ("const", "missing_quality", "missing_condition")
TIER_SLOPE_TERMS = ("t", "t_sq", "log_area", "log_area_sq", "log_lot", "quality_score")
CORE_TERMS = (
    "log_area", "log_age", "land_time", "t", "t_sq", "area_time", "quality_score", "condition_score",
)
CANDIDATE_TERMS = (
    "log_lot", "land_share", "has_garage", "has_basement", "is_view", "missing_quality", "missing_condition",
    "log_elev", "log_major_road", "log_far", "log_eff_age", "bedrooms", "bathrooms", "baths_per_bed",
    "log_lot_sq", "view_aspect_west", "view_elev", "view_level",
)
TIERING_EXTRA_TERMS = ("log_lot", "has_garage", "has_basement", "is_view", "land_share")
PROFILE_EXTRAS = {
    "baseline": (),
    "experimental_elevation": ("slope_pct", "slope_area", "area_elev", "terrain_ruggedness", "aspect_score"),
    "experimental_location": ("log_downtown", "log_schools", "log_amenities", "walkability_score"),
}
INTERACTION_TERMS = {
    "area_quality": ("log_area", "quality_score"),
    "area_condition": ("log_area", "condition_score"),
    "age_quality": ("log_age", "quality_score"),
    "lot_view": ("log_lot", "is_view"),
    "garage_basement": ("has_garage", "has_basement"),
    "area_age_quality": ("log_area", "log_age", "quality_score"),
    "area_age": ("log_area", "log_age"),
    "value_time": ("log_total_mv", "t"),
    "area_lot": ("log_area", "log_lot"),
    "view_elev": ("is_view", "log_elev"),
    "log_major_road_quality": ("log_major_road", "quality_score"),
}
INTERACTION_BUNDLES = {
    "minimal": ("area_quality", "area_condition"),
    "standard": ("area_quality", "area_condition", "age_quality", "value_time"),
    "kitchen_sink": (
        "area_quality", "area_condition", "age_quality", "area_age", "lot_view", "garage_basement", "value_time",
        "area_age_quality", "area_lot", "view_elev", "log_major_road_quality",
    ),
    "location_focused": ("area_quality", "lot_view", "view_elev", "log_major_road_quality"),
}
TIER_TRIMS = {
    "T1_LOW": {"price": (0.05, 0.95), "area": (0.05, 0.95)},
    "T2_MID": {"price": (0.05, 0.95), "area": (0.02, 0.98)},
    "T3_HIGH": {"price": (0.05, 0.99), "area": (0.02, 0.98)},
    "ALL": {"price": (0.05, 0.95), "area": (0.02, 0.98)},
}
DRIVER_GROUPS = {
    "Size & layout": ("log_area", "log_area_sq"),
    "Age & depreciation": ("log_age",),
    "Quality & condition": ("quality_score", "condition_score", "area_quality", "area_condition"),
    "Lot & land": ("log_lot", "log_land_value", "land_share"),
    "Time & market cycle": ("t", "t_sq", "area_time", "land_time", "value_time"),
    "Location & extras": ("is_view", "has_garage", "has_basement"),
}
MIN_ROWS_TIERING, MIN_GROUP_TIERING, MIN_ROWS_FIT = 350, 1300, 30
ANCHOR_DATE, DAYS_PER_MONTH, REFERENCE_YEAR = "2015-01-01", 30.4375, 2025

# The sentences of appeal screening, for an appeal and against one.
APPEAL_REASONS = {
    "over_20": "Assessed value appears 20%+ above market comps.",
    "over_12": "Assessed value ~12–20% above market comps.",
    "over_7": "Assessed value ~7–12% above market comps.",
    "not_over": "Assessed value is at or below market comps.",
    "slightly_over": "Slightly above comps; may be marginal.",
    "comps_5": "5+ recent nearby comparable sales found.",
    "comps_3": "3–4 nearby comparable sales found.",
    "comps_few": "Fewer than 3 strong comparables available.",
    "gap_8": "Your assessment rose far more than your neighborhood average.",
    "gap_4": "Your assessment rose more than the neighborhood average.",
    "gap_none": "Your assessment did not rise more than neighbors.",
    "unreliable": "Neighborhood sample is small or inconsistent (higher COD).",
    "reliable": "Neighborhood sample is large with consistent assessments (low COD).",
    "stop_over": "Assessed value is less than ~7% above market comps.",
    "stop_comps": "Fewer than 3 strong comparable sales are available.",
    "stop_gap": "Your assessment did not rise more than your neighborhood average.",
    "stop_score": "Overall appeal likelihood is below ~45%.",
}

# How adjustment factors are shown.
FACTOR_LABELS = {
    "area": "Living area", "lot": "Lot size", "age": "Age", "quality": "Quality", "condition": "Condition", "garage": "Garage",
    "basement": "Basement", "view": "View", "time": "Time",
}
