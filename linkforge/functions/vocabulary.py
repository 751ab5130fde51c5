"""Terms of fixed vocabularies in texts, and wallet addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge.functions.contact import bound

# Standings of a subject and the cues that tell them.
STATUS = {
    "WANTED": ["wanted", "circulated as wanted"],
    "SUSPECT": ["suspect", "suspected of"],
    "ARRESTED": ["arrested", "under arrest"],
    "CHARGED": ["charged with", "has been charged"],
    "ON_BAIL": ["on bail", "released on bail", "bail conditions"],
    "REMANDED": ["remanded", "on remand"],
    "CONVICTED": ["convicted", "found guilty"],
    "IN_CUSTODY": ["in custody", "in prison", "imprisoned", "incarcerated", "serving a sentence"],
    "ON_LICENCE": ["on licence", "released on licence"],
    "RUI": ["released under investigation", "rui"],
    "WITNESS": ["witness", "eyewitness"],
    "VICTIM": ["victim", "complainant", "injured party"],
    "MISSING": ["missing person", "reported missing", "misper"],
    "DECEASED": ["deceased", "found dead", "pronounced dead"],
    "NFA": ["no further action", "nfa"],
}
# Warning signals and the cues that tell them.
WARNINGS = {
    "VIOLENT": ["violent", "violence", "assault", "gbh", "abh"],
    "WEAPONS": ["weapon", "knife", "bladed", "offensive weapon"],
    "FIREARMS": ["firearm", "armed", "gun"],
    "DRUGS": ["drugs", "controlled substance", "supply of"],
    "ESCAPER": ["escaper", "absconder", "absconded", "unlawfully at large"],
    "SELF_HARM": ["self harm", "suicidal"],
    "CONTAGIOUS": ["contagious", "infectious"],
    "MENTAL": ["mental health", "sectioned", "mental disorder"],
    "ALLEGER": ["makes allegations", "false allegations"],
    "DRIVER": ["disqualified driver", "fails to stop"],
}
# Shapes of wallet addresses, by coin, in the order in which they are looked for.
WALLETS = [
    ("ETH", r"\b0x[a-fA-F0-9]{40}\b"),
    ("BTC", r"\bbc1[ac-hj-np-z02-9]{11,71}\b"),
    ("XMR", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b"),
    ("BTC", r"(?<![A-Za-z0-9])[13][a-km-zA-HJ-NP-Z1-9]{25,34}(?![A-Za-z0-9])"),
]


def cue_text(c: Column) -> Column:
    """Lower-case letters and digits with one blank around each word, so that cues are met as whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def cue_forms(cue: str) -> list[str]:
    """A cue as it is looked for; a single word in singular and plural."""
    forms = [cue] if " " in cue else [cue, f"{cue}s"] + ([cue[:-1]] if cue.endswith("s") else [])
    return [f" {x} " for x in forms]


def detected(c: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The codes whose cues a text holds, in the vocabulary's order; none for null."""

    def any_of(text: Column, cues: list[str]) -> Column:
        found = F.lit(False)
        for form in (f for cue in cues for f in cue_forms(cue)):
            found = found | text.contains(form)
        return found

    return bound(cue_text(c), lambda text: F.filter(F.array(*[F.when(any_of(text, cues), code) for code, cues in vocabulary.items()]), lambda x: x.isNotNull()))


def status(c: Column) -> Column:
    return detected(c, STATUS)


def warnings(c: Column) -> Column:
    return detected(c, WARNINGS)


def wallets(c: Column) -> Column:
    """An array of structs coin, address, in the order of WALLETS and then of the text."""
    def found(coin: str, shape: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(shape), F.lit(0)), lambda x: F.struct(F.lit(coin).alias("coin"), x.alias("address")))

    return F.concat(*[found(*w) for w in WALLETS])
