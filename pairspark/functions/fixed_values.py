"""They must equal the published tables for results to match."""

# Residue alphabet, one-letter codes, `X` = unknown.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYX"
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Residue groups.
RESIDUE_GROUPS = {
    "aliphatic": "AILMV",
    "aromatic": "FWY",
    "polar_neutral": "CNQST",
    "acidic_charged": "DE",
    "basic_charged": "HKR",
}

# Residue properties, in the order of STANDARD_RESIDUES.
RESIDUE_PROPERTIES = {
    "weight": [71.08, 103.15, 115.09, 129.12, 147.18, 57.05, 137.14, 113.16, 128.18, 113.16,
               131.20, 114.11, 97.12, 128.13, 156.19, 87.08, 101.11, 99.13, 186.22, 163.18],
    "pka": [2.34, 1.96, 1.88, 2.19, 1.83, 2.34, 1.82, 2.36, 2.18, 2.36,
            2.28, 2.02, 1.99, 2.17, 2.17, 2.21, 2.09, 2.32, 2.83, 2.32],
    "pkb": [9.69, 10.28, 9.60, 9.67, 9.13, 9.60, 9.17, 9.60, 8.95, 9.60,
            9.21, 8.80, 10.60, 9.13, 9.04, 9.15, 9.10, 9.62, 9.39, 9.62],
    "pkx": [0.00, 8.18, 3.65, 4.25, 0.00, 0.00, 6.00, 0.00, 10.53, 0.00,
            0.00, 0.00, 0.00, 0.00, 12.48, 0.00, 0.00, 0.00, 0.00, 0.00],
    "pi": [6.00, 5.07, 2.77, 3.22, 5.48, 5.97, 7.59, 6.02, 9.74, 5.98,
           5.74, 5.41, 6.30, 5.65, 10.76, 5.68, 5.60, 5.96, 5.89, 5.96],
    "hydrophobic_ph2": [47, 52, -18, 8, 92, 0, -42, 100, -37, 100,
                        74, -41, -46, -18, -26, -7, 13, 79, 84, 49],
    "hydrophobic_ph7": [41, 49, -55, -31, 100, 0, 8, 99, -23, 97,
                        74, -28, -46, -10, -14, -5, 13, 76, 97, 63],
}

# Three-letter residue names.
RESIDUE_NAMES = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H",
    "ILE": "I", "LYS": "K", "LEU": "L", "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q",
    "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y", "ASX": "B",
    "GLX": "Z", "UNK": "X", " * ": "*", "SEC": "C", "MSE": "M",
}

# Atomic numbers per atom class; metals are given by ranges (inclusive).
ATOM_CLASSES = [("B", [5]), ("C", [6]), ("N", [7]), ("O", [8]), ("P", [15]), ("S", [16]), ("Se", [34])]
HALOGENS = [("F", [9]), ("Cl", [17]), ("Br", [35]), ("I", [53])]
METAL_RANGES = [(3, 4), (11, 13), (19, 31), (37, 50), (55, 83), (87, 103)]

# Symbol vocabulary; a symbol outside it takes the last place.
ATOM_SYMBOLS = [
    "C", "N", "O", "S", "F", "Si", "P", "Cl", "Br", "Mg", "Na", "Ca", "Fe", "As", "Al",
    "I", "B", "V", "K", "Tl", "Yb", "Sb", "Sn", "Ag", "Pd", "Co", "Se", "Ti", "Zn", "H",
    "Li", "Ge", "Cu", "Au", "Ni", "Cd", "In", "Mn", "Zr", "Cr", "Pt", "Hg", "Pb", "Unknown",
]

# Hybridization vocabularies, feature families, bond codes.
HYBRIDIZATIONS_FULL = ["SP", "SP2", "SP3", "SP3D", "SP3D2", "other"]
HYBRIDIZATIONS_BASE = ["S", "SP", "SP2", "SP3", "SP3D", "SP3D2"]
FEATURE_FAMILIES = ["Donor", "Acceptor", "Hydrophobe", "LumpedHydrophobe"]
BOND_CODES = {"SINGLE": 1, "DOUBLE": 2, "TRIPLE": 3, "AROMATIC": 4, "UNSPECIFIED": 1}

# Header names of a ligand column.
LIGAND_HEADERS = ["smiles", "smi", "canonical_smiles", "compound_smiles"]

# Length bins (upper bound, name, batch size); longer ones use windows.
LENGTH_BINS = [(300, "short_300", 8), (500, "medium_500", 4), (700, "long_700", 2)]
LONG_BIN = ("sliding", 1)
WINDOW_LENGTH = 700
WINDOW_STRIDE = 350

# Limits of a screening run.
FEATURIZE_CHUNK = 2_000

# Shifted label meaning "binder, effect unknown"; score of an undefined metric.
UNKNOWN_EFFECT_LABEL = 1000
UNDEFINED_SCORE = -999.0
