"""Ordered rules: organism classes, target organisms, pattern groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The codes of each class.
CLASS_CODES = {
    "Gram positive bacteria": [
        "bacillus",
        "corynebacterium",
        "enterococcus",
        "gram_positive_cocci",
        "gram_positive_rod",
        "lactobacillus",
        "leuconostoc",
        "listeria",
        "micrococcus",
        "nocardia",
        "rhodococcus",
        "staphylococcus_coag_neg",
        "staphylococcus_coag_pos",
        "staphylococcus_nos",
        "stomatococcus_mucilaginosis",
        "streptococcus",
    ],
    "Gram negative bacteria": [
        "acinetobacter",
        "agrobacterium_radiobacter",
        "alcaligenes_xylosoxidans",
        "branhamelia_moraxella_catarrhalis",
        "campylobacter",
        "citrobacter",
        "enterobacter",
        "escherichia",
        "flavimonas_oryzihabitans",
        "flavobacterium",
        "gram_negative_diplococci",
        "gram_negative_rod",
        "haemophilus",
        "helicobacter_pylori",
        "klebsiella",
        "legionella",
        "methylobacterium",
        "neisseria",
        "pseudomonas_burkholderia_cepacia",
        "pseudomonas_stenotrophomonas_xanthomonas_maltophilia",
        "pseudomonas_wo_cepacia_maltophilia",
        "salmonella",
        "serratia_marcescens",
        "shigella",
        "vibrio",
    ],
    "Anaerobes": [
        "anaerobes_wo_bacteroides_clostridium",
        "bacteroides",
        "clostridium_difficile",
        "clostridium_wo_difficile",
        "fusobacterium_nucleatum",
        "leptotrichia_buccalis",
        "propionbacterium",
    ],
    "Fungi/yeast": [
        "aspergillus_nos",
        "aspergillus_flavus",
        "aspergillus_fumigatus",
        "aspergillus_niger",
        "candida_albicans",
        "candida_krusei",
        "candida_nos",
        "candida_parapsilosis",
        "candida_tropicalis",
        "cryptococcus",
        "fungus_other",
        "fusarium",
        "mucormycosis_zygomycetes_rhizopus",
        "pneumocystis",
        "torulopsis_galbrata",
        "yeast",
    ],
    "Mycobacteria/AFB": [
        "mycobacteria_avium_bovium_haemophilum_intercelluare",
        "mycobacterium_other",
        "tuberculosis",
        "tuberculosis_nos_afb_kochbacillus",
    ],
    "Parasite/protozoa": [
        "amebiasis",
        "cryptosporidium",
        "echinoco_ocalcyst",
        "giardia",
        "protozoal_other",
        "toxoplasma",
        "trichomonas",
    ],
    "Virus": [
        "adenovirus",
        "cytomegalovirus",
        "enterovirus",
        "epstein_barr_virus",
        "hepatitis_a",
        "hepatitis_b",
        "hepatitis_c",
        "herpes_simplex",
        "herpes_zoster",
        "hhv_6",
        "hiv_htlv",
        "influenza",
        "measles",
        "mumps",
        "papovavirus",
        "parainfluenza",
        "polyomavirus",
        "respiratory_syncytial_virus",
        "rhinovirus",
        "rotavirus",
        "rubella",
        "viral_other",
    ],
    "Atypical/other bacteria": [
        "borrelia",
        "chlamydia",
        "coxiella",
        "leptospira",
        "mycoplasma",
        "rickettsia",
        "treponema",
    ],
    "Other bacteria": [
        "bacteria_other",
        "pharyngeal_respiratory_flora",
    ],
    "No growth/negative": [
        "no_growth",
    ],
    "Other/unspecified": [
        "other_organism",
    ],
}
#: Patterns of each class; the first that matches wins.
_ANAEROBES = "anaerob|bacteroides|clostrid|prevotella|fusobacter|cutibacter|propionibacter|propionbacterium|leptotrichia"
_POSITIVE = "staphylococcus|streptococcus|enterococcus|bacillus|corynebacter|lactobacillus|listeria|leuconostoc|micrococcus|nocardia|rhodococcus|stomatococcus"
_NEGATIVE = "acinetobacter|agrobacterium|alcaligenes|branhamelia|moraxella|pseudomonas|stenotrophomonas|xanthomonas|klebsiella|enterobacter|escherichia|serratia|haemophilus|citrobacter|proteus|neisseria|salmonella|shigella|campylobacter|burkholderia|cepacia|legionella|flavimonas|flavobacterium|helicobacter|methylobacterium|vibrio"
_FIRST = [
    ("Fungi/yeast", "candida|yeast|fung|aspergillus|cryptococcus|mold|mould|saccharomyces|fusarium|mucor|rhizopus|pneumocystis|torulopsis"),
    ("Mycobacteria/AFB", r"mycobacter|tuberculosis|\bafb\b|acid fast"),
    ("Anaerobes", _ANAEROBES),
    ("Parasite/protozoa", "amebiasis|cryptosporidium|echinoco|giardia|protozo|toxoplasma|trichomonas|parasite"),
    ("Virus", "adenovirus|cytomegalovirus|enterovirus|epstein|hepatitis|herpes|hhv|hiv|influenza|measles|mumps|papovavirus|parainfluenza|polyomavirus|respiratory_syncytial|rsv|rhinovirus|rotavirus|rubella|virus|viral|covid|sars|cmv"),
    ("Atypical/other bacteria", "borrelia|chlamydia|coxiella|leptospira|mycoplasma|rickettsia|treponema"),
]
_LAST = [("Other bacteria", "bacteria|gram|cocci|bacilli|rods|flora")]
RULESETS = {
    "exact_then_regex": [*_FIRST, ("Gram positive bacteria", _POSITIVE + "|gram_positive|gram positive|gpc|coag_pos|coag_neg|coagneg"), ("Gram negative bacteria", _NEGATIVE + "|gram_negative|gram negative|gnr"), ("No growth/negative", "no_growth|no growth"), *_LAST],
    "regex_label": [*_FIRST[:2], ("Anaerobes", _ANAEROBES + "|clostridioides"), *_FIRST[3:], ("Gram positive bacteria", _POSITIVE + "|mrsa|vre|gram_positive|gram positive|gpc|coag_pos|coag_neg|coagneg"), ("Gram negative bacteria", _NEGATIVE + "|esbl|cre|carbapenem|gram_negative|gram negative|gnr"), *_LAST],
}
DEFAULT_CLASS = "Other/unspecified"
#: Named targets and their patterns.
TARGETS = [
    ("MRSA", "mrsa|methicillin[ _-]*resistant.*staph|staph.*methicillin[ _-]*resistant"),
    ("Staphylococcus aureus", "staphylococcus[_ ]aureus"),
    ("VRE", r"\bvre\b|vancomycin[ _-]*resistant.*enterococcus|enterococcus.*vancomycin[ _-]*resistant"),
    ("Enterococcus faecium", "enterococcus[_ ]faecium"),
    ("ESBL", r"\besbl\b|extended[ _-]*spectrum"),
    ("CRE", r"\bcre\b|carbapenem[ _-]*resistant|\bkpc\b|\bndm\b"),
    ("Pseudomonas aeruginosa", "pseudomonas[_ ]aeruginosa"),
    ("Klebsiella pneumoniae", "klebsiella[_ ]pneumoniae"),
    ("Escherichia coli", r"escherichia[_ ]coli|\be[._ ]?coli\b"),
    ("Candida auris", "candida[_ ]auris"),
    ("Clostridioides difficile", "clostridioides[_ ]difficile|clostridium[_ ]difficile"),
]
#: Phenotype, organism pattern, drug pattern; the first that matches wins.
PHENOTYPES = [
    ("MRSA", "staphylococcus[_ ]aureus", "oxacillin|cefoxitin|methicillin"),
    ("VRE", "enterococcus", "vancomycin"),
    ("CRE", "escherichia|klebsiella|enterobacter|citrobacter|serratia|proteus", "ertapenem|imipenem|meropenem|doripenem"),
]
#: Pattern and group of organisms and specimens.
ORGANISM_GROUPS = [("staphylococcus aureus", "Staphylococcus aureus"), ("coagulase negative staphylococcus", "Coagulase-negative Staphylococcus"), ("enterococcus", "Enterococcus"), ("escherichia coli", "Escherichia coli"), ("klebsiella", "Klebsiella"), ("pseudomonas", "Pseudomonas"), ("candida", "Candida")]
SPECIMEN_GROUPS = [("blood", "Blood"), ("urine", "Urine"), ("sputum", "Respiratory"), ("bronch", "Bronchoscopy/lower respiratory"), ("wound", "Wound/skin-soft tissue"), ("stool", "Stool/GI"), ("csf", "Cerebrospinal fluid")]


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first (label, pattern) that text matches."""
    out = F.lit(default).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def classify(code: Column, ruleset: str = "exact_then_regex", rules: list[tuple[str, str]] | None = None) -> Column:
    """The class of an organism: its code's, in the exact ruleset; else the first matching pattern's; else the default."""
    clean = F.lower(F.coalesce(code, F.lit("")))
    found = first_match(clean, rules or RULESETS[ruleset], DEFAULT_CLASS)
    if ruleset != "exact_then_regex" or rules:
        return found
    exact = F.lit(None).cast("string")
    for label, codes in CLASS_CODES.items():
        exact = F.when(clean.isin(codes), label).otherwise(exact)
    return F.coalesce(exact, found)


def tag_targets(df: DataFrame, text: Column, targets: list[tuple[str, str]] = TARGETS) -> DataFrame:
    """A row for each target whose pattern text matches: one projection, several labels."""
    tags = F.filter(F.array(*[F.when(text.rlike(p), label) for label, p in targets]), lambda x: x.isNotNull())
    return df.withColumn("target_label", F.explode(tags))


def phenotype(organism: Column, drug: Column, rules: list[tuple[str, str, str]] = PHENOTYPES) -> Column:
    out = F.lit(None).cast("string")
    for label, o, d in reversed(rules):
        out = F.when(organism.rlike(o) & drug.rlike(d), label).otherwise(out)
    return out


def pattern_group(x: Column, groups: list[tuple[str, str]]) -> Column:
    """The group of the first pattern that x contains; null where none does."""
    out = F.lit(None).cast("string")
    for pattern, group in reversed(groups):
        out = F.when(F.lower(x).contains(pattern), group).otherwise(out)
    return out
