"""Published thermodynamic parameters. All tables here are fixed values."""

from __future__ import annotations

import hashlib
import json

GAS, ZERO, T37 = 1.9872, 273.15, 310.15

# Nearest-neighbour steps, kcal/mol and cal/(mol K), 1 M NaCl (SantaLucia 1998).
STEPS = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
}
# Initiation by the terminal pair, and the symmetry term.
END_AT, END_GC, SYMMETRY = (2.3, 4.1), (0.1, -2.8), (0.0, -1.4)

# Internal single mismatches, top step over bottom step (Allawi and SantaLucia 1997, 1998; Peyret 1999).
MISMATCHES = {
    "AA/AT": (4.7, 12.9), "AA/CT": (7.6, 20.2), "AA/GT": (3.0, 7.4), "AA/TA": (1.2, 1.7), "AA/TC": (2.3, 4.6), "AA/TG": (-0.6, -2.3),
    "AC/AG": (-2.9, -9.8), "AC/CG": (-0.7, -3.8), "AC/GG": (0.5, 3.2), "AC/TA": (5.3, 14.6), "AC/TC": (0.0, -4.4), "AC/TT": (0.7, 0.2),
    "AG/AC": (-0.9, -4.2), "AG/CC": (0.6, -0.6), "AG/GC": (-4.0, -13.2), "AG/TA": (-0.7, -2.3), "AG/TG": (-3.1, -9.5), "AG/TT": (1.0, 0.9),
    "AT/TC": (-1.2, -6.2), "AT/TG": (-2.5, -8.3), "AT/TT": (-2.7, -10.8), "CA/AT": (3.4, 8.0), "CA/CT": (6.1, 16.4), "CA/GC": (1.9, 3.7),
    "CA/GG": (-0.7, -2.3), "CA/TT": (1.0, 0.7), "CC/AG": (5.2, 14.2), "CC/CG": (3.6, 8.9), "CC/GC": (-1.5, -7.2), "CC/GT": (-0.8, -4.5),
    "CC/TG": (5.2, 13.5), "CG/GG": (-4.9, -15.3), "CG/GT": (-4.1, -11.7), "CG/TC": (-1.5, -6.1), "CT/GG": (-2.8, -8.0), "CT/GT": (-5.0, -15.8),
    "GA/AT": (0.7, 0.7), "GA/CG": (-0.6, -1.0), "GA/GT": (1.6, 3.6), "GA/TT": (-1.3, -5.3), "GC/CT": (2.3, 5.4), "GC/GG": (-6.0, -15.8),
    "GC/TG": (-4.4, -12.3), "GG/CT": (3.3, 10.4), "GT/CT": (-2.2, -8.4), "TA/CT": (1.2, 0.7), "TA/GT": (-0.1, -1.7), "TA/TT": (0.2, -1.5),
}

# Terminal mismatches behind a Watson-Crick pair (SantaLucia and Peyret 2001).
TERMINAL_MISMATCHES = {
    "AA/TA": (-3.1, -7.8), "TA/AA": (-2.5, -6.3), "CA/GA": (-4.3, -10.7), "GA/CA": (-8.0, -22.5),
    "AC/TC": (-0.1, 0.5), "TC/AC": (-0.7, -1.3), "CC/GC": (-2.1, -5.1), "GC/CC": (-3.9, -10.6),
    "AG/TG": (-1.1, -2.1), "TG/AG": (-1.1, -2.7), "CG/GG": (-3.8, -9.5), "GG/CG": (-0.96 + 310.15 * -19.2 / 1000, -19.2),
    "AT/TT": (-2.4, -6.5), "TT/AT": (-3.2, -8.9), "CT/GT": (-6.1, -16.9), "GT/CT": (-7.4, -21.2),
    "AA/TC": (-1.6, -4.0), "AC/TA": (-1.8, -3.8), "CA/GC": (-2.6, -5.9), "CC/GA": (-2.7, -6.0),
    "GA/CC": (-5.0, -13.8), "GC/CA": (-3.2, -7.1), "TA/AC": (-2.3, -5.9), "TC/AA": (-2.7, -7.0),
    "AC/TT": (-0.9, -1.7), "AT/TC": (-2.3, -6.3), "CC/GT": (-3.2, -8.0), "CT/GC": (-3.9, -10.6),
    "GC/CT": (-4.9, -13.5), "GT/CC": (-3.0, -7.8), "TC/AT": (-2.5, -6.3), "TT/AC": (-0.7, -1.2),
    "AA/TG": (-1.9, -4.4), "AG/TA": (-2.5, -5.9), "CA/GG": (-3.9, -9.6), "CG/GA": (-6.0, -15.5),
    "GA/CG": (-4.3, -11.1), "GG/CA": (-4.6, -11.4), "TA/AG": (-2.0, -4.7), "TG/AA": (-2.4, -5.8),
    "AG/TT": (-3.2, -8.7), "AT/TG": (-3.5, -9.4), "CG/GT": (-3.8, -9.0), "CT/GG": (-6.6, -18.7),
    "GG/CT": (-5.7, -15.9), "GT/CG": (-5.9, -16.1), "TG/AT": (-3.9, -10.5), "TT/AG": (-3.6, -9.8),
}

# Free energy of loops at 37 C by length (SantaLucia and Hicks 2004).
LOOPS = {
    "bulge": {1: 4.0, 2: 2.9, 3: 3.1, 4: 3.2, 5: 3.3, 6: 3.5, 7: 3.7, 8: 3.9, 9: 4.1, 10: 4.3, 12: 4.5, 14: 4.8, 16: 5.0, 18: 5.2, 20: 5.3, 25: 5.6, 30: 5.9},
    "hairpin": {3: 3.5, 4: 3.5, 5: 3.3, 6: 4.0, 7: 4.2, 8: 4.3, 9: 4.5, 10: 4.6, 12: 5.0, 14: 5.1, 16: 5.3, 18: 5.5, 20: 5.7, 25: 6.1, 30: 6.3},
    "internal": {3: 3.2, 4: 3.6, 5: 4.0, 6: 4.4, 7: 4.6, 8: 4.8, 9: 4.9, 10: 4.9, 12: 5.2, 14: 5.4, 16: 5.6, 18: 5.8, 20: 5.9, 25: 6.3, 30: 6.6},
}
AT_CLOSURE = 0.5

# DNA/RNA hybrid steps by the DNA strand, and their initiation (Sugimoto 1995).
HYBRID = {
    "AA": (-7.8, -21.9), "AC": (-5.9, -12.3), "AG": (-9.1, -23.5), "AT": (-8.3, -23.9), "CA": (-9.0, -26.1), "CC": (-9.3, -23.2),
    "CG": (-16.3, -47.1), "CT": (-7.0, -19.7), "GA": (-5.5, -13.5), "GC": (-8.0, -17.1), "GG": (-12.8, -31.9), "GT": (-7.8, -21.6),
    "TA": (-7.8, -23.2), "TC": (-8.6, -22.9), "TG": (-10.4, -28.4), "TT": (-11.5, -36.4),
}
HYBRID_START = (1.9, -3.9)

# Coefficients of the divalent salt correction (Owczarzy 2008).
DIVALENT = (3.92e-5, -9.11e-6, 6.26e-5, 1.42e-5, -4.82e-4, 5.25e-4, 8.31e-5)

# The bases of each IUPAC letter.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}

_OTHER = str.maketrans("ACGT", "TGCA")


def reversed_complement(seq: str) -> str:
    return seq.translate(_OTHER)[::-1]


def all_steps() -> dict[str, tuple[float, float]]:
    """All 16 steps; the other six have the values of their reverse complements."""
    return {a + b: STEPS.get(a + b) or STEPS[reversed_complement(a + b)] for a in "ACGT" for b in "ACGT"}


def mismatch_key(top: str, bottom: str) -> str:
    return min(f"{top}/{bottom}", f"{bottom[::-1]}/{top[::-1]}")


def tables() -> dict[str, dict]:
    return {
        "steps": STEPS, "ends": {"AT": END_AT, "GC": END_GC, "symmetry": SYMMETRY}, "mismatches": MISMATCHES, "terminal_mismatches": TERMINAL_MISMATCHES,
        "loops": LOOPS, "hybrid": HYBRID | {"start": HYBRID_START}, "divalent": {"coefficients": DIVALENT}, "constants": {"at_closure": AT_CLOSURE},
    }


def digest() -> str:
    """SHA-256 over the canonical JSON of each table, in order of names."""
    each = (f"{name}:{hashlib.sha256(json.dumps(t, sort_keys=True, separators=(',', ':')).encode()).hexdigest()}" for name, t in sorted(tables().items()))
    return hashlib.sha256("|".join(each).encode()).hexdigest()


def consistency(tolerance: float = 0.35) -> list[tuple[str, str]]:
    """What of the tables contradicts itself: (table, key) of steps that differ from their reverse complement, mismatches that
    aren't, and loops that get more stable with length by more than the tolerance."""
    faults = [("steps", s) for s, v in all_steps().items() if all_steps()[reversed_complement(s)] != v]
    for name, table in (("mismatches", MISMATCHES), ("terminal_mismatches", TERMINAL_MISMATCHES)):
        for key in table:
            top, bottom = key.split("/")
            if sum(a == b.translate(_OTHER) for a, b in zip(top, bottom, strict=True)) != 1:
                faults.append((name, key))
    for kind, table in LOOPS.items():
        sizes = sorted(k for k in table if k >= 6)
        faults += [(kind, str(b)) for a, b in zip(sizes, sizes[1:], strict=False) if table[b] < table[a] - tolerance]
    return faults
