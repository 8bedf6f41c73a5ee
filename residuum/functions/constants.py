"""Fixed values of the domain, in natural order."""

# Residue names of structures and their one-letter codes.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "VAL": "V", "PYX": "C", "SEP": "S", "TPO": "T", "TYS": "Y", "MK8": "L", "M3L": "K", "DPR": "P",
    "DSN": "S", "ALN": "A", "DLY": "K", "MVA": "V", "MLE": "L", "DLE": "L", "CSO": "C", "PTR": "Y", "BMT": "T",
    "DAL": "A", "FAK": "K", "MSE": "M", "SMF": "A", "HYP": "P",
}

# Mutation classes of annotation tables.
CODING_CLASSES = (
    "Translation_Start_Site", "Frame_Shift_Del", "Frame_Shift_Ins", "In_Frame_Del", "In_frame_Del", "In_Frame_Ins",
    "Missense_Mutation", "Missense", "Nonsense_Mutation", "Nonsense", "Nonstop_Mutation", "Silent", "Synonymous",
    "Splice_Site", "Start_Codon_DNP", "Start_Codon_Del", "Start_Codon_Ins", "Start_Codon_ONP", "Stop_Codon_DNP",
    "Stop_Codon_Del", "Stop_Codon_Ins", "RNA", "lincRNA", "De_novo_Start_InFrame", "Start_Codon_SNP", "Read-through",
    "Splice_Region", "Splice_Site_DNP", "Splice_Site_Del", "Splice_Site_Ins", "Splice_Site_ONP", "Splice_Site_SNP",
    "Splice_site", "Splice_site_SNP",
)
NONCODING_CLASSES = (
    "3'UTR", "5'Flank", "3'Flank", "5'UTR", "De_novo_Start_OutOfFrame", "IGR", "Intron", "Non-coding_Transcript",
)

# Ligands from solvents and buffers.
SOLVENT_LIGANDS = (
    "SO4", "GOL", "CL", "EDO", "CA", "NAG", "NA", "PO4", "ACT", "PEG", "K", "NDG", "IOD", "MPD", "PG4", "BME", "DMS",
    "FUC", "CIT", "EPE", "ACY", "MES", "TRS", "MAN", "FMT", "PGE", "IPA", "NO3", "FLC", "1PE", "CO", "BMA", "IMD",
    "DTT", "SCN", "GAL", "BR", "BGC", "MLI", "GLC", "CAC", "P6G", "OLA", "AKG", "MRD", "OGA",
)

# Length scales of the proximity score in Angstrom, the reported one, the adaptive stop.
SCALES = (3.0, 4.5, 6.0, 8.0, 10.0)
REPORTED_SCALE = 2
STOP_THRESHOLD = 0.05271
LYSINE = ("LYS",)
PHOSPHO = ("SER", "TYR", "THR")

BASES = "acgt"
#: The standard genetic code: amino acids of the codons in the order of ``tcag`` for each base.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("tcag") for j, b in enumerate("tcag") for k, c in enumerate("tcag")}


def channels() -> list[str]:
    """The 96 channels as ``abc-n``: context of a middle ``a`` or ``c``, and the new base."""
    return [f"{a}{m}{b}-{n}" for a in BASES for b in BASES for m in "ac" for n in BASES if n != m]
