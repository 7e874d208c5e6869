"""Values that files and results must agree on."""

# Fixed values of the text format and of the exports.
DEFAULT_GRAPH = "TSG_DEFAULT_GRAPH"
PROGRAM_HEADER = ("PG", "tsg")
GTF_SOURCE = "tsg"
PATH_PREFIX = "TSP"
PATH_DIGITS = 10
#: Length of an identifier when none is asked for.
IDENTIFIER_LENGTH = 64
#: Rounds of the pairwise bubble search.
BUBBLE_ROUNDS = 100
READ_IDENTITIES = ("SO", "IN", "SI")
ATTRIBUTE_TYPES = "ifZJHB"
ELEMENT_KINDS = ("N", "E", "U", "P", "C", "G")
SUMMARY_COLUMNS = ("gid", "nodes", "edges", "paths", "max_path_len", "super_path", "is_cyclic", "is_connected", "topology")

# The header of the VCF output, without the leading "##" and the column line.
VCF_INFO = (
    ("CANONICAL", "0", "Flag", "Canonical splice site"),
    ("NONCANONICAL", "0", "Flag", "Noncanonical splice site"),
    ("BOUNDARY", "1", "String", "The coding exon boundary type of event, BOTH, LEFT, RIGHT, NEITHER."),
    ("DP1", "1", "Integer", "Total read depth at the breakpoint1"),
    ("DP2", "1", "Integer", "Total read depth at the breakpoint2"),
    ("SR", "1", "Integer", "The number of support reads for the breakpoints"),
    ("OSR", "1", "Integer", "The number of support reads for the breakpoints before rescuer"),
    ("PSI", "1", "Float", "Estimated Percent splice-in in the range (0,1], representing the percentage of NLS transcripts"),
    ("SVMETHOD", "1", "String", "Type of approach used to detect SV"),
    ("SVTYPE", "1", "String", "The type of event, DEL, TDUP, IDUP, INV, TRA."),
    ("SVLEN", "1", "Integer", "Difference in length between REF and ALT alleles"),
    ("CHR2", "1", "String", "Chromosome for END coordinate in case of a translocation"),
    ("SVEND", "1", "Integer", "2nd position of the structural variant"),
    ("END", "1", "Integer", "A placeholder for END coordinate in case of a translocation"),
    ("STRAND1", "1", "String", "Strand for breakpoint1"),
    ("STRAND2", "1", "String", "Strand for breakpoint2"),
    ("MODE1", "1", "String", "Mode for softclipped reads at breakpoint1"),
    ("MODE2", "1", "String", "Mode for softclipped reads at breakpoint2"),
    ("GENE1", "1", "String", "Overlapped coding gene for breakpoint1"),
    ("GENE2", "1", "String", "Overlapped coding gene for breakpoint2"),
    ("MEGAEXON1", ".", "String", "ID for source mega exon"),
    ("MEGAEXON2", ".", "String", "ID for target mega exon"),
    ("HOMSEQ", "1", "String", "MicroHomology sequence"),
    ("INSSEQ", "1", "String", "MicroInsertion sequence"),
    ("TRANSCRIPT_ID", ".", "String", "Transcript ID"),
    ("GENE_ID", "1", "String", "Gene ID"),
    ("SR_ID", ".", "String", "Support read ID"),
)
VCF_ALT = (
    ("DEL", "Deletion"), ("TDUP", "Tandem duplication"), ("IDUP", "Inverted duplication"), ("INV", "Inversion"),
    ("TRA", "Translocation"),
)
VCF_COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
VCF_VERSION = "VCFv4.3"
