"""Default word lists of the rules, in English with a few words of the other
test languages.  ``using`` puts other lists in their place for one rendering,
and ``segq.plans.core.run`` takes them by name.  The lists of diseases,
treatments, courses, laboratory words and dangers are ours, after headings of
the public MeSH thesaurus (trees C, E and D)."""

import threading
from contextlib import contextmanager

RENDERING = threading.RLock()


@contextmanager
def using(**lists):
    """Other lists for the time of one rendering; one thread at a time."""
    unknown = set(lists) - {k for k in globals() if k.isupper()}
    if unknown:
        raise KeyError(f"no such lists: {sorted(unknown)}")
    with RENDERING:
        before = {k: globals()[k] for k in lists}
        globals().update(lists)
        try:
            yield
        finally:
            globals().update(before)


UNITS = ("mg", "ml", "mcg", "kg", "mmol", "iu", "units")
POLARITY = ("positive", "negative", "positiv", "negativ", "positif", "positivo", "negativo")
COURSE = ("fulminant", "intermittent", "latent", "progressive", "relapsing", "remission", "subacute", "fortschreitend", "schubweise", "évolutif", "progresivo")
DIRECTION = ("left", "right", "upper", "lower", "anterior", "posterior", "medial", "lateral", "links", "rechts", "gauche", "droite", "izquierdo", "derecho")
DIAGNOSIS = ("abscess", "anemia", "fibrosis", "fracture", "infection", "inflammation", "ischemia", "neoplasm", "stenosis", "ulcer", "entzündung", "infektion", "fracture", "infección")
TREATMENT = ("amputation", "anesthesia", "dialysis", "immunization", "radiotherapy", "rehabilitation", "resuscitation", "transfusion", "ventilation", "bestrahlung", "impfung", "rééducation", "vacunación")
LAB = ("albumin", "bilirubin", "cholesterol", "creatinine", "ferritin", "glucose", "hemoglobin", "platelets", "serum", "urea", "glukose", "hémoglobine", "plaquetas")
PROCEDURE = ("biopsy", "endoscopy", "tomography", "puncture", "angiography", "biopsie", "endoskopie", "biopsia")
MEDICATION = ("drug", "tablet", "capsule", "ointment", "solution", "cream", "antibiotic", "tablette", "salbe", "pommade", "pastilla")
NEGATION = ("not", "no", "without", "never", "nicht", "kein", "ohne", "ne", "pas", "sans", "sin")
LOGIC = ("although", "because", "despite", "however", "otherwise", "therefore", "whereas")
DANGER = ("anaphylaxis", "asphyxia", "cardiac arrest", "coma", "hemorrhage", "poisoning", "sepsis", "shock", "suicide")
ROOTS = ("cardi", "neur", "gastr", "hepat", "derm", "oste", "onco", "path", "logi", "itis", "tion", "ment")
SUFFIXES = ("itis", "osis", "oma", "ectomy", "logy", "pathy", "tion", "ment", "heit")
#: Words of which English text has at least two.
COMMON_EN = ("the", "a", "is", "and", "to", "of", "in", "for", "with", "be", "as")
DEGREES = ("md", "phd", "prof", "professor", "dr")
INSTITUTION = ("university", "institute", "hospital", "department", "clinic", "universität", "université", "universidad")
SPECIALTY = ("cardiology", "oncology", "surgery", "neurology", "pediatrics")
TITLE = ("chapter", "introduction", "conclusion", "results", "methods", "table", "figure")
STOP_EN = ("the", "a", "an", "of", "and", "or", "to", "in", "for", "with", "on", "by")
#: Strings that must survive as they are, case sensitive.
ABBREVIATIONS = ("mg", "ml", "g", "kg", "mmol", "%", "IU", "mm", "cm", "h", "hr", "min", "sec")

#: (term, forbidden target, reason): generic one-word targets and mappings.
FORBIDDEN = (
    ("the", "idiot", "generic_single_word_target"),
    ("and", "trash", "generic_single_word_target"),
    ("for", "clown", "dangerous_mismatch:register"),
    ("that", "stupid", "dangerous_mismatch:register"),
)
#: (bad phrase, suggestion): style rules.
STYLE = (("of the", "the"), ("in the", "within"), ("to be", "being"))
#: What checks of meaning and style are told.
CHECK_RULES = ("The back check looks at meaning only.", "The style check looks for literal calques and odd collocations.")
KNOWN_RISKS = ("numbers", "units", "negation", "left/right", "upper/lower", "inner/outer", "literal calques")
#: (source terms, expected in target, opposite): paired meaning rules.
PAIRS = (("left", "left", "right"), ("high", "high", "low"), ("with", "with", "without"))
#: (part of the headword, target that must never stand for it); the last two
#: are of the test tables.
DANGEROUS = (("left", "right"), ("plate", "brand#8"), ("ring", "brand#19"))
TYPOS = (("teh", "the"), ("recieve", "receive"), ("seperate", "separate"), ("occured", "occurred"), ("adress", "address"), ("definately", "definitely"), ("goverment", "government"), ("wich", "which"))
ADJECTIVES = ("al", "ous", "ic", "ive", "ful", "ish", "ary")
GENERIC = ("system", "method", "value", "type", "part", "brand")

#: Fixed values: (rule, type, label, source phrases, expected, opposite) of the
#: six paired meaning rules.
PAIR_RULES = (
    ("laterality_left", "laterality_shift", "left/right", ("левый", "левая", "левое", "левой", "слева"), ("left",), ("right",)),
    ("laterality_right", "laterality_shift", "left/right", ("правый", "правая", "правое", "правой", "справа"), ("right",), ("left",)),
    ("inner", "inner_outer_shift", "inner/outer", ("внутренний", "внутренняя", "внутреннее", "внутренней"), ("inner", "internal"), ("outer", "external")),
    ("outer", "inner_outer_shift", "inner/outer", ("наружный", "наружная", "наружное", "наружной", "внешний"), ("outer", "external"), ("inner", "internal")),
    ("upper", "upper_lower_shift", "upper/lower", ("верхний", "верхняя", "верхнее", "верхней"), ("upper",), ("lower",)),
    ("lower", "upper_lower_shift", "upper/lower", ("нижний", "нижняя", "нижнее", "нижней"), ("lower",), ("upper",)),
    # Of the test tables.
    ("left", "laterality_shift", "left/right", ("left", "links", "gauche"), ("left",), ("right",)),
    ("high", "upper_lower_shift", "upper/lower", ("high", "of the"), ("high",), ("low", "of a")),
)
#: Fixed values but for the explanations: (bad, preferred, source phrase, type,
#: severity, explanation) of the six style rules.
STYLE_RULES = (
    ("outer circuit", "outer contour", "контур", "terminology", "major", "An outline is a contour, not a circuit."),
    ("bay-like", "scalloped", "бухтообразный", "literal_calque", "major", "A literal calque; radiology says scalloped."),
    ("lung root", "hilar region", "корень легкого", "terminology", "major", "The root of the lung is the hilum or hilar region."),
    ("enlightenment", "radiolucency", "просветление", "terminology", "major", "On a radiograph this is radiolucency."),
    ("decay", "cavitation", "распад", "terminology", "major", "Breakdown of tissue is cavitation or destruction."),
    ("hearth", "focus", "очаг", "terminology", "major", "A focus, lesion or opacity, not a hearth."),
    # Of the test tables.
    ("in the", "within", "", "weak_collocation", "minor", "A weak collocation."),
)
#: Negations of either side.
NEGATION_SOURCE = ("не", "нет", "без", "отрицает", "исключено", "не выявлено")
NEGATION_TARGET = ("no", "not", "without", "denies", "denied", "negative for", "not detected", "not identified")
#: Fixed values, as patterns: units that count behind a number.
ISSUE_UNITS = ("mg", "mcg", "kg", "ml", "mm hg", "mmhg", "mm", "cm", "bpm", "iu", "u/l", "mmol/l", "мг", "мкг", "кг", "мл", "мм рт[.]? ст[.]?", "мм", "см")
#: Terms and targets that the glossary rule passes over.
ISSUE_SKIP_TERMS = ("сахар", "нос", "отношение", "первичный")
ISSUE_SKIP_TARGETS = ("sugar", "nose", "attitude", "white")
#: Time that the rows of a run bear.
RUN_TIME = ("2024-05-01T10:00:00Z",)

#: US dollars a million tokens in and out, and a million
#: characters of machine translation.
PRICES = (("translate_in", 5), ("translate_out", 15), ("qa_in", 5), ("qa_out", 15), ("backcheck_in", 5), ("backcheck_out", 15), ("safety_in", 5), ("safety_out", 15), ("mt", 25))
#: Prices of a run in place of those; names that are not among them are passed over.
PRICE_OVERRIDES = ()
