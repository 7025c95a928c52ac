"""Every tunable number and list in one frozen value; an alternative setting is another value, not global state."""

from __future__ import annotations

from dataclasses import dataclass

CLEAR, NOISY, TRASH, NON_TEXT, EMPTY = "Clear", "Noisy", "Trash", "Non-text", "Empty"
CATEGORIES = (CLEAR, EMPTY, NOISY, NON_TEXT, TRASH)

# Default thresholds, character sets and word lists.
CZECH_DIACRITICS = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
GERMAN_DIACRITICS = "äöüßÄÖÜ"
VOWELS = "aeiouyáéíóúýěůäöüAEIOUYÁÉÍÓÚÝĚŮÄÖÜ"
ROTATABLE = "pbqdnuwmoxszeyv"
STRIP = ".,;:!?()[]\"'/\\"
ALLOWED_INTERNAL = ".-,+()\"'/—–:%;?!/"
SINGLE_ALLOWED = "aAiIuUvVzZkKsS"
TITLES = ("PhDr", "MUDr", "JUDr", "MVDr", "RNDr", "PaedDr", "CSc", "DrSc", "Ing", "Mgr", "Bc", "PhD", "DiS", "prof", "doc")
UNITS = ("m", "cm", "mm", "g", "kg", "km", "ha", "l", "ml")
SHORT_VALID = ("a", "i", "k", "o", "s", "u", "v", "z", "se", "si", "po", "na", "za", "ze", "do", "od", "ke", "ku", "ve", "ní", "mi", "ti", "by", "je", "to", "co", "ač", "my", "ty", "on", "ji", "jí", "už", "až")
UPRIGHT_WORDS = ("po", "pod", "do", "od", "on", "ony", "by", "bez", "ne", "nebo", "ven", "den", "zde", "se", "ve", "mez", "pouze", "bude")
NOT_GHOSTS = ("no", "bo")
METADATA_MARKERS = ("Tb.", "č.neg", "neg.", "obr.", "obr ", "neg ", "Tb ", "č. neg", "č.neg.", "č.", "str.", "Datum")
NON_TEXT_MARKERS = ("IVerc",)
#: Words that say nothing of quality, and signs that may follow a number.
NEUTRAL = ("mm", "cm", "m", "g", "kg", "km", "ha", "l", "ml", "tb", "neg", "obr", "str", "č", "čneg")
AFTER_NUMBER = ".,/:%-;?)="
#: What a mirrored and an upside-down letter looks like.
MIRROR = {"b": "d", "d": "b", "p": "q", "q": "p", "a": "a", "e": "e", "i": "i", "l": "l", "m": "m", "n": "n", "o": "o", "s": "s", "t": "t", "u": "u", "v": "v", "w": "w", "x": "x", "y": "y", "z": "z"}
ROTATE = {"b": "q", "q": "b", "d": "p", "p": "d", "h": "y", "n": "u", "u": "n", "m": "w", "w": "m", "y": "h", "a": "e", "e": "a", "i": "!", "l": "l", "o": "o", "s": "s", "x": "x", "z": "z"}
#: Cost of a label flipped from the first to the second; other flips cost 1.
FLIP_COSTS = {
    ("Clear", "Trash"): 3.0, ("Clear", "Non-text"): 3.0, ("Clear", "Noisy"): 1.0, ("Noisy", "Clear"): 0.5, ("Noisy", "Trash"): 2.0,
    ("Noisy", "Non-text"): 2.0, ("Trash", "Clear"): 2.0, ("Trash", "Noisy"): 1.0, ("Non-text", "Clear"): 2.0, ("Trash", "Non-text"): 0.25,
}


def ghost_words() -> tuple[str, ...]:
    """What mirrored or upside-down scans make of the upright words."""
    upright, out = set(UPRIGHT_WORDS), set()
    for glyphs in (MIRROR, ROTATE):
        out |= {"".join(glyphs[c] for c in reversed(w)) for w in upright if all(c in glyphs for c in w)}
    return tuple(sorted(out - upright - set(NOT_GHOSTS)))


@dataclass(frozen=True)
class EngineConfig:
    w_valid: float = 0.35
    w_weird: float = 0.18
    w_garbage: float = 0.18
    w_perplexity: float = 0.08
    w_vowel: float = 0.07
    w_lang: float = 0.05
    w_gibberish: float = 0.04
    w_fused: float = 0.03
    w_length: float = 0.02
    length_max: float = 100.0
    perplexity_max: float = 1000.0
    short_perplexity_cap: float = 850.0
    garbage_norm: float = 0.35
    vowel_low: float = 0.20
    vowel_high: float = 0.70
    short_penalty: float = 0.20
    trash_max: float = 0.55
    noisy_max: float = 0.80
    soft_margin: float = 0.35
    garbage_high: float = 0.35
    hard_sweep_lang: float = 0.45
    hard_sweep_perplexity: float = 1000.0
    extreme_perplexity: float = 3000.0
    extreme_lang: float = 0.85
    absolute_perplexity: float = 30000.0
    low_perplexity_clear: float = 50.0
    czech_clear_perplexity: float = 180.0
    czech_clear_garbage: float = 0.15
    readable_valid: float = 0.85
    rotatable_high: float = 0.65
    inverted_perplexity: float = 200.0
    inverted_rotatable: float = 0.55
    rotated_lang: float = 0.90
    inverted_run: int = 4
    inverted_majority: float = 0.60
    surrounded_margin: float = 0.15
    page_garbage_clear: float = 0.05
    page_garbage_lang: float = 0.50
    page_garbage_median: float = 0.55
    page_garbage_noisy: float = 0.80
    page_clean_clear: float = 0.60
    page_clean_median: float = 0.80
    page_clean_recover: float = 0.45
    expected_langs: tuple[str, ...] = ("ces", "deu", "eng")
    trusted_langs: tuple[str, ...] = ("deu", "eng", "fra", "pol", "ita", "slk")
    trusted_tier: float = 0.85
    unknown_tier: float = 0.50
    disabled_rules: tuple[str, ...] = ()
    #: The category of lines with a web or mail address; None: the other rules decide.
    notation_category: str | None = None
    #: Whether the shape witness may condemn short lines.
    witness: bool = False


DEFAULT = EngineConfig()
