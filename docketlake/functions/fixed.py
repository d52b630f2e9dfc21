"""Word lists, patterns and tables whose contents decide results."""

# clean-energy tags, lower case
CLEAN = [
    "carbon capture and sequestration",
    "conventional energy production - nuclear",
    "conventional energy production - other",
    "renewable energy production - biomass",
    "renewable energy production - energy storage",
    "renewable energy production - geothermal",
    "renewable energy production - hydrokinetic",
    "renewable energy production - hydropower",
    "renewable energy production - other",
    "renewable energy production - solar",
    "renewable energy production - wind, offshore",
    "renewable energy production - wind, onshore",
    "nuclear technology",
    "electricity transmission",
    "utilities (electricity, gas, telecommunications)",
]

# fossil tags, lower case
FOSSIL = [
    "conventional energy production - coal",
    "conventional energy production - land-based oil & gas",
    "conventional energy production - rural energy",
    "conventional energy production - offshore oil and gas",
    "pipelines",
]

UTILITIES = "utilities (electricity, gas, telecommunications)"
BROADBAND = "broadband"
NUCLEAR_TECH = "nuclear technology"
NUCLEAR_POWER = "conventional energy production - nuclear"

# tags that with utilities alone suggest a project without energy
NON_ENERGY = ["broadband", "waste management", "land development - housing", "land development - other", "land development - urban"]

# states and their abbreviations
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}

# spellings of capacity units
UNITS = {
    "mw": "MW", "mwac": "MW", "mwdc": "MW", "mwe": "MW", "mwt": "MW", "mwth": "MW", "mwp": "MW", "megawatt": "MW", "megawatts": "MW",
    "megawatt electric": "MW", "megawatt-electric": "MW", "megawatt thermal": "MW", "megawatt-thermal": "MW", "gw": "GW", "gwe": "GW",
    "gigawatt": "GW", "gigawatts": "GW", "kw": "kW", "kwe": "kW", "kilowatt": "kW", "kilowatts": "kW", "mwh": "MWh", "gwh": "GWh",
    "kwh": "kWh", "megawatt hour": "MWh", "megawatt-hour": "MWh", "gigawatt hour": "GWh", "gigawatt-hour": "GWh",
    "kilowatt hour": "kWh", "kilowatt-hour": "kWh",
}

# departments: prefixes in order of test, then whole names
DEPARTMENT_PREFIXES = [
    "Department of Energy", "Department of the Interior", "Department of Agriculture", "Department of Defense",
    "Department of Homeland Security", "Department of Transportation", "Department of Health and Human Services",
    "Department of Housing and Urban Development", "Department of Commerce", "Department of State", "Department of Justice",
    "Department of Veterans Affairs", "Department of the Treasury", "Major Independent Agencies", "Other Independent Agencies",
    "General Services Administration",
]
DEPARTMENT_NAMES = ["Legislative Branch", "International Assistance Programs"]
DEPARTMENT_OTHER = "Other / Unclassified"

# nuclear-waste sites and offices
WASTE_TERMS = [
    "nnsa", "national nuclear security administration", "kansas city", "livermore", "lawrence livermore", "los alamos", "naval nuclear",
    "nevada", "pantex", "sandia", "savannah river", "y-12", "office of legacy management", "legacy management",
    "albuquerque operations office", "grand junction office", "office of environmental management", "environmental management",
    "hanford", "richland", "office of river protection", "paducah", "portsmouth", "oak ridge", "waste isolation pilot plant", "carlsbad",
]
WASTE_AGENCIES = ["national nuclear security administration", "office of legacy management", "office of environmental management"]

# document types by category, in order of test
DOCUMENT_TYPES = {"decision": ["ROD", "FONSI", "CE"], "final": ["FEIS", "EA"], "draft": ["DEIS", "DEA"], "other": ["OTHER", ""]}
_NO, _END = r"(?:^|[^a-zA-Z])", r"(?:[^a-zA-Z]|$)"
FILE_NAME_PATTERNS = {
    "decision": [
        rf"{_NO}ROD{_END}", r"Record[_\-\s]?of[_\-\s]?Decision", rf"{_NO}FONSI{_END}",
        r"Finding[_\-\s]?of[_\-\s]?No[_\-\s]?Significant[_\-\s]?Impact", r"Categorical[_\-\s]?Exclusion",
    ],
    "final": [
        rf"{_NO}FEIS{_END}", r"Final[_\-\s]?E(?:nvironmental[_\-\s]?)?I(?:mpact[_\-\s]?)?S(?:tatement)?", rf"Final[_\-\s]?EA{_END}",
        r"Final[_\-\s]?Environmental[_\-\s]?Assessment",
    ],
    "draft": [
        rf"{_NO}DEIS{_END}", r"Draft[_\-\s]?E(?:nvironmental[_\-\s]?)?I(?:mpact[_\-\s]?)?S(?:tatement)?", rf"{_NO}DEA{_END}",
        r"Draft[_\-\s]?E(?:nvironmental[_\-\s]?)?A(?:ssessment)?",
    ],
    "appendix": [rf"{_NO}Appendix", rf"{_NO}Appendices{_END}", rf"{_NO}Attachment", rf"{_NO}Exhibit{_END}"],
}

# dates: patterns in order of priority, with the group that holds year, month, day (0: none)
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
MONTHS_SHORT = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
DATE_PATTERNS = [
    ("MDY_full", rf"({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})", (3, 1, 2)),
    ("MDY_short", rf"({MONTHS_SHORT})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", (3, 1, 2)),
    ("DMY_full", rf"(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})", (3, 2, 1)),
    ("numeric_slash", r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    ("numeric_slash_2y", r"(\d{1,2})/(\d{1,2})/(\d{2})\b", (3, 1, 2)),
    ("ISO", r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    ("numeric_dash", r"(\d{1,2})-(\d{1,2})-(\d{4})", (3, 1, 2)),
    ("digital_sig", r"(\d{4})\.(\d{2})\.(\d{2})", (1, 2, 3)),
    ("MY_full", rf"({MONTHS})\s+(\d{{4}})", (2, 1, 0)),
    ("MY_short", rf"({MONTHS_SHORT})\.?\s+(\d{{4}})", (2, 1, 0)),
]
MONTH_NUMBERS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9,
    "oct": 10, "nov": 11, "dec": 12,
}

# context types of a date, in order of test
DATE_CONTEXTS = {
    "start": ["commenced", "initiated", "began", "starting", "start date", "initiated on"],
    "submission": ["submitted", "filed", "received", "application date"],
    "notice": ["notice of intent", "noi", "published", "federal register"],
    "draft": ["draft", "deis", "dea"],
    "final": ["final", "feis", "fea"],
    "decision": ["decision", "rod", "record of decision", "fonsi", "finding of no significant impact", "approved", "signed", "issued"],
    "comment": ["comment period", "public comment", "comments due"],
    "scoping": ["scoping", "scoping period"],
}

# phrases near a date that make it a statute or citation
DATE_EXCLUSIONS = [
    "act of 19", "act of 20", "act (19", "act (20", "policy act", "preservation act", "conservation act", "management act",
    "protection act", "improvement act", "reform act", "recovery act", "species act", "water act", "air act", "lands act", "statute",
    "u.s.c.", "usc", "public law", "p.l.", "amended in", "accessed on", "retrieved on", "available at", "et al.", "et al,", "eds.",
    "editor", "vol.", "volume", "pp.", "pages", "journal", "proceedings", "report no.", "technical report", "isbn", "issn", "doi:",
]
CITATIONS = [r"\b[A-Z][a-z]+\.\s*\d{4}\.", r"\b[A-Z]{2,}\.\s*\d{4}\.", r"\(\d{4}\)", r"\d{4}[a-z]?\)"]

DECISION_CUES = [
    "signed", "signature", "digitally signed", "approved", "approval", "determination", "decision", "decision memorandum",
    "final approval", "authorizing official", "field manager", "field office manager", "field office manager determination",
    "nepa compliance officer", "environmental coordinator", "concur", "date determined", "initiator signature",
]
INITIATION_CUES = [
    "initiated", "initiate", "consultation", "consulted", "scoping", "notice of intent", "noi", "submitted", "submission",
    "application received", "received", "request received", "proposal submitted", "prepared and submitted", "comment period",
    "30-day comment period", "request for", "right-of-way application", "row application", "right of way application",
    "document creation", "date created", "date prepared", "prepared", "drafted", "revised", "reviewed",
]
CONTEXT_EXCLUSIONS = [
    r"\b\d+\s*FR\s*\d+\b", r"\b\d+\s*CFR\s*\d+\b", r"\b\d+\s*U\.?S\.?C\.?\b", r"\bFederal Register\b", r"https?://", r"\bOMB Control\b",
    r"\bPaperwork Reduction\b",
]

# capacity: number, range, prefix, units in order
NUMBER = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?"
NUMBER_RANGE = rf"({NUMBER})(?=[\s–—mgkt-])(?:\s*(?:-|–|—|to)\s*({NUMBER}))?"
NUMBER_PREFIX = r"(?:about|approx(?:\.|imately)?|approximately|up to|~)\s*"
POWER_UNITS = [
    "MW", "MWac", "MWdc", "MWe", "MWt", "MWth", "MWp", "GW", "GWe", "kW", "kWe", "kWac", "kWdc", "GWac", "GWdc",
    r"megawatt(?:-?\s*electric)?s?", r"megawatt(?:-?\s*thermal)?s?", r"gigawatt(?:-?\s*electric)?s?", r"kilowatt(?:-?\s*electric)?s?",
]
ENERGY_UNITS = ["MWh", "GWh", "kWh", r"megawatt-?\s*hours?", r"gigawatt-?\s*hours?", r"kilowatt-?\s*hours?"]
# what stands in (?=...) follows from the rest; it ends a vain attempt at its first letter
UNIT = f"(?=[mgk])({'|'.join(POWER_UNITS + ENERGY_UNITS)})"
CAPACITY_PATTERNS = [
    rf"(?=[\dau~])(?:{NUMBER_PREFIX})?{NUMBER_RANGE}\s*{UNIT}",
    rf"(?=[cgponr])(?:capacity|generating|generate|produces?|output|nameplate|rated|net)\s+(?:of\s+)?(?:{NUMBER_PREFIX})?{NUMBER_RANGE}\s*{UNIT}",
    rf"(?=[\dau~])(?:{NUMBER_PREFIX})?{NUMBER_RANGE}\s*-?\s*{UNIT}\s+(?:facility|project|plant|farm|array|solar|wind|power|battery|storage)",
    rf"[Aa]\s+(?:{NUMBER_PREFIX})?{NUMBER_RANGE}\s*-?\s*{UNIT}\s+\w+",
]
PROJECT_WORDS = ["project", "proposed", "facility", "plant", "farm", "array", "system", "nameplate", "rated", "net", "capacity", "would", "will", "generate"]
HISTORICAL_WORDS = ["existing", "previous", "previously", "former", "historical", "nearby", "adjacent", "another", "other", "currently", "prior", "legacy"]
AMBIGUOUS_WORDS = ["similar", "comparable", "reference", "example"]
INVALID_CAPACITY = ["mw-year", "mw yr", "mw/yr", "mwy", "$/mw", "$ /mw", "per mw", "mw per"]

# sentence filter before a language model
CAPACITY_TERMS = [
    "mw", "gw", "kw", "mwh", "gwh", "kwh", "megawatt", "megawatts", "gigawatt", "gigawatts", "kilowatt", "kilowatts", "megawatt-hour",
    "megawatt-hours", "kilowatt-hour", "kilowatt-hours", "nameplate", "capacity", "generate", "generates", "generating", "generation",
    "output", "rated", "produce", "produces", "producing",
]
TYPE_TERMS = {
    "solar": ["ac", "dc", "photovoltaic", "pv", "panel", "array"],
    "wind": ["turbine", "rotor", "nacelle"],
    "nuclear": ["mwe", "megawatt-electric", "reactor", "thermal", "mwt"],
    "geothermal": ["binary", "flash", "steam", "wellhead"],
    "hydropower": ["dam", "turbine", "head", "flow"],
    "hydrokinetic": ["tidal", "wave", "current"],
    "biomass": ["btu", "british thermal", "boiler", "combustion"],
    "storage": ["battery", "storage", "discharge", "duration"],
    "transmission": ["kv", "kilovolt", "volt", "voltage", "transfer"],
    "carbon capture": ["co2", "capture", "sequestration", "tons", "mwe"],
}
POWER_WORDS = ["solar", "wind", "nuclear", "geothermal", "hydropower", "hydrokinetic", "biomass", "energy production", "energy storage"]
SENTENCE_WORDS = ["project", "proposed", "facility", "plant", "farm", "array", "system", "generate", "capacity", "nameplate", "rated"]
NUMBER_UNIT = r"\d[\d,\.]*\s*(?:MW|GW|kW|MWh|GWh|kWh|megawatt|gigawatt|kilowatt|MWe|MWt)"
TYPE_PRIORITY = {"FEIS": 1, "DEIS": 2, "EA": 3, "DEA": 4, "FONSI": 5, "ROD": 6, "CE": 7, "OTHER": 8, "": 5}

# places: coordinates, counties, abbreviations of states
LAT_LON = r"Lat/Lon:\s*([-]?\d+\.?\d*),\s*([-]?\d+\.?\d*)"
COUNTY = r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+County"
STATE_CODE = r"(?:,\s*|\s)([A-Z]{2})(?:\s|$|[;,\)])"

# ends of sentences before a language model
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n\n+"

# forms of a date in a model's answer
REPLY_DATES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.M.d"),
]

# tags of the notebook's clean flag, as written
NOTEBOOK_CLEAN = [
    "Carbon Capture and Sequestration", "Conventional Energy Production - Nuclear", "Renewable Energy Production - Biomass",
    "Renewable Energy Production - Energy Storage", "Renewable Energy Production - Geothermal",
    "Renewable Energy Production - Hydrokinetic", "Renewable Energy Production - Hydropower", "Renewable Energy Production - Solar",
    "Renewable Energy Production - Wind, Offshore", "Renewable Energy Production - Wind, Onshore", "Renewable Energy Production - Other",
    "Nuclear Technology", "Electricity Transmission", "Utilities (electricity, gas, telecommunications)",
]

# keyword bank of the snippet extractor, by category
SNIPPET_PATTERNS = {
    "decision_signatures": [
        r"Authorizing\s+Official", r"Field\s+(?:Office\s+)?Manager", r"NEPA\s+Compliance\s+Officer", r"Environmental\s+Coordinator",
        r"Digitally\s+signed", r"D\.\s*Signature", r"FIELD\s+OFFICE\s+MANAGER\s+DETERMINATION", r"Program\s+Lead\s*\[?Signature",
        r"Reviewing\s+Official", r"Approving\s+Official", r"District\s+Manager", r"Forest\s+Supervisor", r"Regional\s+Forester",
    ],
    "date_labels": [
        r"Date\s+Determined", r"Date\s+Approved", r"Approval\s+Date", r"Effective\s+Date", r"Expiration\s+Date", r"Decision\s+Date",
        r"Date\s+of\s+Decision", r"Signed\s+Date", r"Issue\s+Date", r"Date\s+Issued", r"Date\s+Signed", r"Revised\s*:", r"Amended\s*:",
    ],
    "section_headers": [
        r"DECISION\s+RECORD", r"NEPA\s+DETERMINATION", r"NEPA\s+PROVISION", r"CATEGORICAL\s+EXCLUSION\s+DOCUMENTATION",
        r"CATEGORICAL\s+EXCLUSION\s+WORKSHEET", r"CATEGORICAL\s+EXCLUSION\s+REVIEW", r"C\.\s+Compliance\s+with\s+NEPA",
        r"COMPLIANCE\s+WITH\s+NEPA", r"A\.\s+Background", r"FINDING\s+OF\s+NO\s+SIGNIFICANT\s+IMPACT", r"RECORD\s+OF\s+DECISION",
    ],
    "application_indicators": [
        r"application\s+(?:received|submitted|date)", r"received\s+on", r"submitted\s+on", r"Proposal\s+Date",
        r"Project\s+(?:Start|Initiation|Began)", r"Date\s+(?:Received|Submitted)", r"Application\s+Date", r"Request\s+(?:Date|Received)",
        r"(?:APD|Application)\s+received",
    ],
    "plan_dates": [
        r"RMP.*?Date\s+Approved", r"Resource\s+Management\s+Plan.*?(?:approved|Approved)", r"Land\s+Use\s+Plan.*?(?:approved|Approved)",
        r"Record\s+of\s+Decision.*?\d{4}",
    ],
    "agency_specific": [
        r"DOE\s+NEPA", r"DOE\s+Order\s+451", r"EERE\s+PROJECT", r"NETL", r"Savannah\s+River", r"BLM\s+Office\s*:",
        r"BUREAU\s+OF\s+LAND\s+MANAGEMENT", r"Case\s+File\s+No", r"Serial\s+(?:No|Number)", r"516\s+DM", r"USDA\s+Forest\s+Service",
        r"National\s+Forest", r"Ranger\s+District", r"Army\s+Corps", r"USACE", r"Fish\s+and\s+Wildlife\s+Service", r"USFWS",
        r"DEPARTMENT\s+OF\s+THE\s+INTERIOR", r"DEPARTMENT\s+OF\s+ENERGY", r"DEPARTMENT\s+OF\s+AGRICULTURE",
    ],
    "project_types": [
        r"Right-of-Way", r"ROW\s+(?:Grant|Application|Amendment)", r"(?:Special\s+)?(?:Use\s+)?Permit", r"Lease\s+(?:Application|Amendment)",
        r"Land\s+Use\s+(?:Permit|Authorization)", r"Easement", r"License\s+(?:Application|Amendment)",
        r"(?:Oil|Gas|Mining)\s+(?:Lease|Permit|Application)", r"APD", r"Sundry\s+Notice", r"(?:Renewable|Solar|Wind)\s+Energy",
        r"Transmission\s+(?:Line|Project)", r"Pipeline",
    ],
    "date_formats": [r"FY\s*\d{2,4}", r"Fiscal\s+Year\s+\d{4}", r"Calendar\s+Year\s+\d{4}", r"(?:Winter|Spring|Summer|Fall)\s+\d{4}", r"Q[1-4]\s+\d{4}"],
}

# long process names
PROCESS_NAMES = {
    "Environmental Assessment (EA)": "EA",
    "Environmental Impact Statement (EIS)": "EIS",
    "Categorical Exclusion": "CE",
}
