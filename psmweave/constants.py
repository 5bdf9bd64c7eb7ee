"""Fixed values of the domain: residue masses, modification labels, engine names.

These values must be equal in every program that reads the same result files,
so they are stated as plain tables.
"""

# Monoisotopic residue masses in Dalton.
RESIDUE_MASS = {
    "G": 57.021463719204,
    "A": 71.037113783,
    "S": 87.03202840226,
    "P": 97.052763846796,
    "V": 99.068413910592,
    "T": 101.047678466056,
    "C": 103.00918495654,
    "L": 113.084063974388,
    "I": 113.084063974388,
    "N": 114.042927438408,
    "D": 115.02694302152,
    "Q": 128.058577502204,
    "K": 128.094963010536,
    "E": 129.04259308531599,
    "M": 131.040485084132,
    "H": 137.058911855296,
    "F": 147.068413910592,
    "R": 156.10111101903598,
    "Y": 163.06332852985201,
    "W": 186.07931294673998,
}

# Monoisotopic mass shift of each modification label (UNIMOD).
MODIFICATION_MASS = {
    "UNIMOD:1": 42.010565,
    "UNIMOD:4": 57.021464,
    "UNIMOD:5": 43.005814,
    "UNIMOD:7": 0.984016,
    "UNIMOD:21": 79.966331,
    "UNIMOD:23": -18.010565,
    "UNIMOD:35": 15.994915,
    "UNIMOD:385": -17.026549,
    "+25.980265": 25.980265,
    "Formula:H-2C1O1": 25.979265,
}

# Particle and molecule masses.
PROTON_MASS = 1.007276466812
WATER_MASS = 18.0105646837
AMMONIA_MASS = 17.0265491015
CARBON_MONOXIDE_MASS = 27.9949146221
HYDROGEN_MASS = 1.00782503207
NEUTRON_MASS = 1.00866491606
CARBON_ISOTOPE_DELTA = 1.00335
ISOTOPE_SPACING = 1.003355

# Engine notation -> ProForma notation, applied in this order.
# An entry whose target ends in "-" is an N-terminal modification.
ENGINE_MODIFICATIONS = {
    "casanovo": [
        ("C+57.021", "C[UNIMOD:4]"),
        ("M+15.995", "M[UNIMOD:35]"),
        ("N+0.984", "N[UNIMOD:7]"),
        ("Q+0.984", "Q[UNIMOD:7]"),
        ("+43.006-17.027", "[+25.980265]-"),
        ("+42.011", "[UNIMOD:1]-"),
        ("+43.006", "[UNIMOD:5]-"),
        ("-17.027", "[UNIMOD:385]-"),
    ],
    "instanovo": [
        ("C(+57.02)", "C[UNIMOD:4]"),
        ("M(ox)", "M[UNIMOD:35]"),
        ("M(+15.99)", "M[UNIMOD:35]"),
        ("N(+.98)", "N[UNIMOD:7]"),
        ("Q(+.98)", "Q[UNIMOD:7]"),
        ("[UNIMOD:1]", "[UNIMOD:1]-"),
        ("[UNIMOD:5]", "[UNIMOD:5]-"),
        ("[UNIMOD:385]", "[UNIMOD:385]-"),
    ],
    "instanovoplus": [
        ("C(+57.02)", "C"),
        ("M(ox)", "M[UNIMOD:35]"),
        ("M(+15.99)", "M[UNIMOD:35]"),
        ("N(+.98)", "N[UNIMOD:7]"),
        ("Q(+.98)", "Q[UNIMOD:7]"),
        ("[UNIMOD:1]", "[UNIMOD:1]-"),
        ("[UNIMOD:5]", "[UNIMOD:5]-"),
        ("[UNIMOD:385]", "[UNIMOD:385]-"),
    ],
    "contranovo": [
        ("+43.006-17.027", "[+25.980265]-"),
        ("-17.027+43.006", "[+25.980265]-"),
        ("+42.011", "[UNIMOD:1]-"),
        ("+43.006", "[UNIMOD:5]-"),
        ("-17.027", "[UNIMOD:385]-"),
        ("C+57.021", "C[UNIMOD:4]"),
        ("M+15.995", "M[UNIMOD:35]"),
        ("N+0.984", "N[UNIMOD:7]"),
        ("Q+0.984", "Q[UNIMOD:7]"),
    ],
    "pepnet": [("Z", "M[UNIMOD:35]"), ("C", "C[UNIMOD:4]")],
    "novob": [
        ("C", "C[UNIMOD:4]"),
        ("m", "M[UNIMOD:35]"),
        ("n", "N[UNIMOD:7]"),
        ("q", "Q[UNIMOD:7]"),
        ("s", "S[UNIMOD:21]"),
        ("t", "T[UNIMOD:21]"),
        ("y", "Y[UNIMOD:21]"),
    ],
    "novor": [("C(1)", "C[UNIMOD:4]"), ("M(0)", "M[UNIMOD:35]")],
    "pepnovo": [("M+16", "M[UNIMOD:35]"), ("C", "C[UNIMOD:4]")],
    "general": [("acetylation", "[UNIMOD:1]")],
    "percolator": [
        ("57.02147", "UNIMOD:4"),
        ("15.99492", "UNIMOD:35"),
        ("42.01057", "UNIMOD:1"),
        ("-17.02655", "UNIMOD:385"),
        ("-18.01056", "UNIMOD:23"),
    ],
    "sage": [("+57.0215", "UNIMOD:4"), ("+15.9949", "UNIMOD:35")],
    "parquet": [("+57.0215", "UNIMOD:4"), ("+15.9949", "UNIMOD:35")],
    "spectralis": [
        ("M[UNIMOD:35]", "M[UNIMOD:35]"),
        ("C[UNIMOD:4]", "C[UNIMOD:4]"),
    ],
    "piprimenovo": [
        ("[+43.006-17.027]-", "[+25.980265]-"),
        ("[+42.011]-", "[UNIMOD:1]-"),
        ("[+43.006]-", "[UNIMOD:5]-"),
        ("[-17.027]-", "[UNIMOD:385]-"),
        ("C[+57.021]", "C[UNIMOD:4]"),
        ("M[+15.995]", "M[UNIMOD:35]"),
        ("N[+0.984]", "N[UNIMOD:7]"),
        ("Q[+0.984]", "Q[UNIMOD:7]"),
    ],
    "pihelixnovo": [
        ("+43.006-17.027", "[+25.980265]-"),
        ("+42.011", "[UNIMOD:1]-"),
        ("+43.006", "[UNIMOD:5]-"),
        ("-17.027", "[UNIMOD:385]-"),
        ("C+57.021", "C[UNIMOD:4]"),
        ("M+15.995", "M[UNIMOD:35]"),
        ("N+0.984", "N[UNIMOD:7]"),
        ("Q+0.984", "Q[UNIMOD:7]"),
    ],
    "adanovo": [
        ("+43.006-17.027", "[+25.980265]-"),
        ("+42.011", "[UNIMOD:1]-"),
        ("+43.006", "[UNIMOD:5]-"),
        ("-17.027", "[UNIMOD:385]-"),
        ("C(+57.02)", "C[UNIMOD:4]"),
        ("M(+15.99)", "M[UNIMOD:35]"),
        ("N(+.98)", "N[UNIMOD:7]"),
        ("Q(+.98)", "Q[UNIMOD:7]"),
    ],
    "deepnovo": [
        ("Cmod", "C[UNIMOD:4]"),
        ("Qmod", "Q[UNIMOD:7]"),
        ("Nmod", "N[UNIMOD:7]"),
        ("Mmod", "M[UNIMOD:35]"),
    ],
}

# Result file extension per engine label.
RESULT_EXTENSION = {
    "casanovo": ".mztab",
    "contranovo": ".mztab",
    "adanovo": ".mztab",
    "instanovo": ".csv",
    "novob": ".tsv",
    "pepnet": ".tsv",
    "novor": ".csv",
    "pepnovo": ".mgf.out",
    "percolator": ".pout",
    "sage": ".sage.tsv",
    "spectralis": ".csv",
    "instanovoplus": ".csv",
    "pihelixnovo": ".tsv",
    "piprimenovo": ".tsv",
    "deepnovo": ".tsv",
    "parquet": ".parquet",
}

# Source label in result files -> canonical engine name.
ENGINE_LABEL = {
    "Casanovo4.2.0": "casanovo",
    "ContraNovo": "contranovo",
    "InstaNovo": "instanovo",
    "NovoB": "novob",
    "PepNet": "pepnet",
    "pihelixnovo": "pi-HelixNovo",
    "piprimenovo": "pi-PrimeNovo",
    "adanovo": "AdaNovo",
}

# Modifications the diffusion refiner cannot read.
REFINER_UNSUPPORTED = ["[+25.980265]-", "[Formula:H-2C1O1]", "UNIMOD:23"]

# ProForma -> notation of the older diffusion refiner input.
REFINER_NOTATION = [
    ("M[UNIMOD:35]", "M(+15.99)"),
    ("N[UNIMOD:7]", "N(+.98)"),
    ("Q[UNIMOD:7]", "Q(+.98)"),
    ("C[UNIMOD:4]", "C(+57.02)"),
]

# ProForma -> notation of the spectrum-rescoring refiner, in order.
SPECTRALIS_NOTATION = [
    ("[Formula:H-2C1O1]", ""),
    ("[+25.980265]-", ""),
    ("[UNIMOD:1]-", ""),
    ("[UNIMOD:5]-", ""),
    ("[UNIMOD:385]-", ""),
    ("[UNIMOD:23]", ""),
    ("[UNIMOD:1]", ""),
    ("[UNIMOD:5]", ""),
    ("[+25.980265]", ""),
    ("[UNIMOD:385]", ""),
    ("-", ""),
    ("S[UNIMOD:21]", "S"),
    ("T[UNIMOD:21]", "T"),
    ("Y[UNIMOD:21]", "Y"),
    ("Q[UNIMOD:7]", "E"),
    ("N[UNIMOD:7]", "D"),
    ("C[UNIMOD:4]", "C"),
]

# One letter per (modified) residue, in order.
LETTER_CODE = [
    ("[+25.980265]-", "b"),
    ("[Formula:H-2C1O1]-", "b"),
    ("[UNIMOD:1]-", "z"),
    ("[UNIMOD:5]-", "d"),
    ("[UNIMOD:385]-", "e"),
    ("Q[UNIMOD:7]", "q"),
    ("N[UNIMOD:7]", "n"),
    ("C[UNIMOD:4]", "c"),
    ("M[UNIMOD:35]", "v"),
    ("S[UNIMOD:21]", "s"),
    ("T[UNIMOD:21]", "t"),
    ("Y[UNIMOD:21]", "y"),
    ("L", "I"),
]

# Deamidated residues weigh as much as their acids.
DEAMIDATION = [("N[UNIMOD:7]", "D"), ("Q[UNIMOD:7]", "E")]

# Comparison classes from best to worst.
ERROR_TYPES = [
    "match",
    "isobaric_aa",
    "isobaric_peak",
    "Higher score",
    "Lower score",
    "Different",
]

# Class order when one PSM per spectrum is selected.
SELECTION_ORDER = ["match", "Higher score", "isobaric_aa", "isobaric_peak", "Lower score"]

# Residue pairs that are hard to tell apart by mass.
ISOBARIC_PAIRS = [("I", "L"), ("M", "F"), ("K", "Q"), ("D", "N"), ("E", "Q")]

# Alphabet of the residue-combination mass table; the two last
# entries are carbamidomethylated cysteine and oxidised methionine.
MASS_TABLE_RESIDUES = [
    "A", "D", "E", "F", "G", "H", "L", "K", "M", "N", "P", "Q", "R", "S", "T", "V", "W", "Y",
    "C[UNIMOD:4]", "M[UNIMOD:35]",
]
