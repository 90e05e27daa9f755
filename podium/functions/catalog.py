"""Fixed values that parsers compare with: names of parts and places. Each can be replaced by the caller's own."""

from __future__ import annotations

#: Lock chips and main blades of compound blades.
LOCK_CHIPS = [
    "Cerberus", "Dran", "Emperor", "Fox", "Hells", "Hornet", "Kraken", "Leon", "Pegasus", "Perseus", "Phoenix", "Rhino",
    "Sol", "Stag", "Valkyrie", "Whale", "Wizard", "Wolf",
]
MAIN_BLADES = [
    "Antler", "Arc", "Blast", "Brave", "Brush", "Dark", "Eclipse", "Fang", "Flame", "Flare", "Fort", "Hunt", "Might",
    "Reaper", "Volt", "Wriggle",
]
#: Compound blades that are read otherwise than by their words.
COMPOUND_EXCEPTIONS = {"Pegasus Flame": ("Pegasus", "Flare")}
#: Compound blades that the normaliser takes apart.
COMPOUND_BLADES = [
    "Dran Brave", "Emperor Brave", "Wizard Arc", "Perseus Dark", "Hells Reaper", "Fox Brush", "Pegasus Blast",
    "Cerberus Blast", "Hells Blast", "Emperor Blast", "Wolf Blast", "Dran Blast", "Valkyrie Blast", "Valkyrie Blast W",
    "Valkyrie Blast S", "Sol Blast", "Perseus Blast W", "Kraken Blast", "Sol Eclipse", "Emperor Eclipse",
    "Hells Eclipse", "Wolf Hunt", "Emperor Hunt", "Perseus Hunt", "Emperor Might", "Cerberus Might", "Dran Might",
    "Whale Might", "Phoenix Flare", "Pegasus Flame", "Valkyrie Volt", "Valkyrie Volt A",
]
#: The chip that a main blade is given where its own is lost.
DEFAULT_CHIPS = {
    "Blast": "Pegasus", "Might": "Emperor", "Brave": "Dran", "Arc": "Wizard", "Reaper": "Hells", "Brush": "Fox",
    "Eclipse": "Sol", "Hunt": "Wolf", "Flare": "Phoenix", "Volt": "Valkyrie",
}
#: Assist blades by their abbreviation.
ASSISTS = {
    "S": "Slash", "B": "Bumper", "J": "Jaggy", "R": "Round", "T": "Turn", "C": "Charge", "M": "Massive", "H": "Heavy",
    "Z": "Zillion", "W": "Wheel", "F": "Free", "D": "Dual",
}
#: Blades in their proper word order.
BLADES = [
    "Dran Sword", "Hells Scythe", "Knight Shield", "Knight Lance", "Wizard Arrow", "Shark Edge", "Viper Tail",
    "Dran Dagger", "Hells Hammer", "Leon Claw", "Dran Buster", "Hells Chain", "Rhino Horn", "Black Shell",
    "Tyranno Beat", "Unicorn Sting", "Phoenix Wing", "Wizard Rod", "Aero Pegasus", "Silver Wolf", "Shark Slayer",
    "Samurai Saber", "Weiss Tiger", "Talon Ptera", "Spike Cadeus", "Roar Tyranno", "Cobalt Dragoon", "Cobalt Drake",
    "Steel Samurai", "Burn Wyvern", "Prominence Phoenix", "Whale Wave", "Knight Mail", "Leon Crest", "Wyvern Gale",
    "Phoenix Feather", "Tusk Mammoth", "Phoenix Rudder", "Dranzer Spiral", "Pegasus Blast", "Wizard Arc", "Fox Brush",
    "Hells Blast", "Valkyrie Volt", "Blast Emperor", "Emperor Brave", "Dran Brave", "Might Blast", "Hover Wyvern",
    "Shark Scale", "Meteor Dragoon", "Impact Drake", "Rock Golem", "Samurai Calibur", "Crimson Garuda",
    "Scorpio Spear", "Shinobi Shadow", "Ghost Circle", "Bite Croc", "Keel Shark", "Knife Shinobi", "Shelter Drake",
    "Sphinx Cowl", "Tide Whale", "Tricera Press", "Bear Scratch", "Chain Incendio", "Clock Mirage", "Dragoon Storm",
    "Driger Slash", "Gill Shark", "Mummy Curse", "Scythe Incendio", "Sting Unicorn", "Wand Wizard", "Xeno Xcalibur",
    "Cerberus Blast",
]
#: Spellings of blades without spaces that no rule finds.
BLADE_SPELLINGS = {"hellscythe": "Hells Scythe"}
#: Bits by abbreviation.
BITS = {
    "B": "Ball", "F": "Flat", "N": "Needle", "P": "Point", "T": "Taper", "S": "Spike", "O": "Orb", "D": "Dot",
    "A": "Accel", "R": "Rush", "H": "Hexa", "C": "Cyclone", "U": "Unite", "L": "Level", "E": "Elevate", "G": "Glide",
    "Q": "Quake", "K": "Kick", "V": "Vanguard", "W": "Wedge", "Z": "Zap", "M": "Merge", "J": "Jolt",
    "HN": "High Needle", "LF": "Low Flat", "LR": "Low Rush", "LN": "Low Needle", "GF": "GearFlat", "GB": "GearBall",
    "GN": "GearNeedle", "GP": "GearPoint", "MN": "Metal Needle", "HT": "High Taper", "HA": "High Accel",
    "DB": "Disc Ball", "HS": "High Sword", "SN": "Spiral Needle", "Lv": "Level", "El": "Elevate", "Un": "Unite",
    "Br": "Brake", "Bd": "Bound", "Gl": "Glide", "Hex": "Hexa", "FB": "Free Ball", "WB": "Wall Ball",
    "WW": "Wall Wedge", "BS": "Bound Spike", "TK": "Trans Kick", "TP": "Trans Point", "UF": "Under Flat",
    "UN": "Under Needle", "RA": "Rubber Accel",
}
#: Bits as the Japanese and the German source read them; both have maps of their own.
BITS_BY_SOURCE = {
    "jp": {
        "B": "Ball", "F": "Flat", "N": "Needle", "P": "Point", "T": "Taper", "S": "Spike", "O": "Orb", "D": "Dot",
        "A": "Accel", "R": "Rush", "H": "Hexa", "C": "Cyclone", "U": "Unite", "L": "Level", "E": "Elevate", "G": "Glide",
        "Q": "Quake", "K": "Kick", "V": "Vanguard", "HN": "High Needle", "LF": "Low Flat", "LR": "Low Rush",
        "LN": "Low Needle", "GF": "GearFlat", "GB": "GearBall", "GN": "GearNeedle", "GP": "GearPoint",
        "MN": "Metal Needle", "HT": "High Taper", "HA": "High Accel", "DB": "Disc Ball", "HS": "High Sword",
        "SN": "Spiral Needle",
    },
    "de": {
        "B": "Ball", "F": "Flat", "N": "Needle", "P": "Point", "T": "Taper", "S": "Spike", "O": "Orb", "D": "Dot",
        "A": "Accel", "R": "Rush", "H": "Hexa", "C": "Cyclone", "U": "Unite", "L": "Level", "E": "Elevate", "G": "Glide",
        "Q": "Quake", "K": "Kick", "V": "Vanguard", "J": "Jolt", "HN": "High Needle", "LF": "Low Flat", "LR": "Low Rush",
        "LN": "Low Needle", "LO": "Low Orb", "GF": "GearFlat", "GB": "GearBall", "GN": "GearNeedle", "GP": "GearPoint",
        "MN": "Metal Needle", "HT": "High Taper", "HA": "High Accel", "DB": "Disc Ball", "HS": "High Sword",
        "SN": "Spiral Needle", "FB": "Free Ball", "RA": "Rush Accel",
    },
}
#: Sources that write bits in any case.
UPPER_BITS = ["de"]
#: Chips, assists, event words and placement words in Japanese.
KANA_CHIPS = {
    "ペガサス": "Pegasus", "ドラン": "Dran", "ウィザード": "Wizard", "ペルセウス": "Perseus", "ヘルズ": "Hells",
    "フォックス": "Fox", "ソル": "Sol", "ウルフ": "Wolf", "エンペラー": "Emperor", "フェニックス": "Phoenix",
    "ヴァルキリー": "Valkyrie", "ケルベロス": "Cerberus",
}
KANA_ASSISTS = {
    "ジャギー": "Jaggy", "スラッシュ": "Slash", "ホイール": "Wheel", "バンパー": "Bumper", "ヘビー": "Heavy",
    "アサルト": "Assault", "ラッシュ": "Rush", "ロー": "Low", "ラッシュアサルト": "Rush Assault", "ローオービット": "Low",
    "バンパースラッシュ": "Bumper Slash", "アッパーフラット": "Upper Flat", "ギアラッシュ": "Gear Rush",
    "ホイールバンパー": "Wheel Bumper", "W": "Wheel", "H": "Heavy", "S": "Slash", "J": "Jaggy",
}
EVENT_WORDS = {
    "G1大会": "G1 Tournament", "日本選手権": "Japan Championship", "ワールドチャンピオンシップ": "World Championship",
    "アジアチャンピオンシップ": "Asia Championship", "エクストリームカップGP": "Extreme Cup GP",
    "ランダムブースターカップ": "Random Booster Cup", "東京": "Tokyo", "大阪": "Osaka", "名古屋": "Nagoya",
    "福岡": "Fukuoka", "札幌": "Sapporo", "仙台": "Sendai", "横浜": "Yokohama", "神戸": "Kobe", "京都": "Kyoto",
    "広島": "Hiroshima", "レギュラークラス": "Regular Class", "オープンクラス": "Open Class", "決勝": "Finals",
    "準決勝": "Semi-Finals", "予選": "Preliminaries",
}
PLACE_WORDS = {"1位": 1, "2位": 2, "3位": 3, "優勝": 1, "準優勝": 2, "3位入賞": 3}
#: Bits of two words that are also written as one.
SPACED_BITS = [
    "Gear Flat", "Gear Ball", "Gear Needle", "Gear Point", "Gear Rush", "Low Flat", "Low Rush", "Low Needle", "Low Orb",
    "High Needle", "High Taper", "High Accel", "Disc Ball", "Metal Needle", "Free Ball", "Wall Ball", "Wall Wedge",
    "Bound Spike", "Trans Kick", "Trans Point", "Under Flat", "Under Needle", "Rubber Accel",
]
#: Rewrites of the normaliser, in order. Those of blades are a parameter.
BIT_REWRITES = {
    "U": "Unite", "L": "Level", "E": "Elevate", "G": "Glide", "Q": "Quake", "K": "Kick", "V": "Vanguard",
    "Lv": "Level", "El": "Elevate", "Un": "Unite", "Br": "Brake", "Bd": "Bound", "Gl": "Glide", "WB": "Wall Ball",
    "UN": "Under Needle", "RA": "Rubber Accel", "FB": "Free Ball", "UF": "Upper Flat", "GF": "Gear Flat",
    "GB": "Gear Ball", "GN": "Gear Needle", "GP": "Gear Point", "HN": "High Needle", "LF": "Low Flat",
    "LR": "Low Rush", "LN": "Low Needle", "MN": "Metal Needle", "HT": "High Taper", "HA": "High Accel",
    "DB": "Disc Ball", "Hex": "Hexa", "LowOrb": "Low Orb", "WallBall": "Wall Ball", "FreeBall": "Free Ball",
    "HighNeedle": "High Needle", "LowFlat": "Low Flat", "LowRush": "Low Rush", "LowNeedle": "Low Needle",
    "GearFlat": "Gear Flat", "GearBall": "Gear Ball", "GearNeedle": "Gear Needle", "GearPoint": "Gear Point",
    "MetalNeedle": "Metal Needle", "HighTaper": "High Taper", "HighAccel": "High Accel", "DiscBall": "Disc Ball",
    "RubberAccel": "Rubber Accel", "UnderNeedle": "Under Needle", "UpperFlat": "Upper Flat", "RushAccel": "Rush Accel",
}
RATCHET_REWRITES = {"5-50": "4-50"}
#: Misspelt blades of the short list of fixes.
BLADE_FIXES = {
    "Aero Pegaus": "Aero Pegasus", "Roar Tyrnano": "Roar Tyranno", "Samauri Saber": "Samurai Saber",
    "Wizard Arrow.": "Wizard Arrow", "Wizardr Rod": "Wizard Rod", "phoenix": "Phoenix Wing", "uster": "Dran Buster",
    "|| KnightLance": "Knight Lance", "|| KnightShield": "Knight Shield", "Samurai": "Samurai Saber",
    "Phoenix": "Phoenix Wing",
}
#: Countries by region, in the order in which they are looked for.
COUNTRIES = {
    "NA": ["usa", "us", "united states", "canada", "mexico"],
    "EU": [
        "uk", "united kingdom", "england", "france", "germany", "spain", "italy", "netherlands", "belgium", "poland",
        "sweden", "norway", "finland", "denmark", "ireland", "portugal", "austria", "switzerland", "scotland", "wales",
        "greece", "czech", "hungary", "romania",
    ],
    "JAPAN": ["japan", "日本"],
    "ASIA": [
        "korea", "south korea", "china", "taiwan", "hong kong", "singapore", "malaysia", "philippines", "indonesia",
        "thailand", "vietnam", "india",
    ],
    "OCEANIA": ["australia", "new zealand"],
    "SA": ["brazil", "argentina", "chile", "colombia", "peru"],
}
#: States and provinces of North America, by name and abbreviation.
STATES = [
    "alabama", "al", "alaska", "ak", "arizona", "az", "arkansas", "ar", "california", "ca", "colorado", "co",
    "connecticut", "ct", "delaware", "de", "florida", "fl", "georgia", "ga", "hawaii", "hi", "idaho", "id", "illinois",
    "il", "indiana", "in", "iowa", "ia", "kansas", "ks", "kentucky", "ky", "louisiana", "la", "maine", "me", "maryland",
    "md", "massachusetts", "ma", "michigan", "mi", "minnesota", "mn", "mississippi", "ms", "missouri", "mo", "montana",
    "mt", "nebraska", "ne", "nevada", "nv", "new hampshire", "nh", "new jersey", "nj", "new mexico", "nm", "new york",
    "ny", "north carolina", "nc", "north dakota", "nd", "ohio", "oh", "oklahoma", "ok", "oregon", "or", "pennsylvania",
    "pa", "rhode island", "ri", "south carolina", "sc", "south dakota", "sd", "tennessee", "tn", "texas", "tx", "utah",
    "ut", "vermont", "vt", "virginia", "va", "washington", "wa", "west virginia", "wv", "wisconsin", "wi", "wyoming",
    "wy", "district of columbia", "dc",
]
PROVINCES = [
    "ontario", "on", "quebec", "qc", "british columbia", "bc", "alberta", "ab", "manitoba", "mb", "saskatchewan", "sk",
    "nova scotia", "ns", "new brunswick", "nb", "newfoundland", "nl", "prince edward island", "pei", "pe",
    "northwest territories", "nt", "nunavut", "nu", "yukon", "yt",
]
#: Cities by region, in the order in which they are looked for.
CITIES = {
    "NA": [
        "los angeles", "new york", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas",
        "san jose", "austin", "jacksonville", "san francisco", "seattle", "denver", "boston", "las vegas", "portland",
        "detroit", "atlanta", "miami", "orlando", "tampa", "sacramento", "tempe", "tucson", "mesa", "fresno", "toronto",
        "vancouver", "montreal", "calgary", "edmonton", "ottawa", "winnipeg",
    ],
    "EU": [
        "london", "paris", "berlin", "madrid", "rome", "amsterdam", "brussels", "vienna", "munich", "barcelona", "milan",
        "manchester",
    ],
    "JAPAN": ["tokyo", "osaka", "kyoto", "nagoya"],
    "ASIA": ["seoul", "beijing", "shanghai", "hong kong", "singapore", "taipei", "bangkok"],
    "OCEANIA": ["sydney", "melbourne", "brisbane", "auckland", "wellington"],
}
#: Cities that captions name.
CAPTION_CITIES = [
    "Berlin", "Hamburg", "München", "Munich", "Köln", "Cologne", "Frankfurt", "Stuttgart", "Düsseldorf", "Dortmund",
    "Essen", "Leipzig", "Bremen", "Dresden", "Hannover", "Nürnberg", "Nuremberg", "Duisburg", "Bochum", "Wuppertal",
    "Bielefeld", "Bonn", "Münster", "Karlsruhe", "Mannheim", "Augsburg", "Wiesbaden", "Braunschweig", "Bad Homburg",
    "Walldorf", "Kaiserslautern", "Erfurt", "Kiel",
]
#: Cities that head the sections of prose results.
SECTION_CITIES = ["大阪", "仙台", "福岡", "広島", "東京", "札幌", "名古屋", "神戸"]
