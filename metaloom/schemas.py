"""Fixed values of the domain: enumerations, dimensions, dictionaries."""

from __future__ import annotations

# Platforms.
PLATFORMS = [
    "LS454", "ILLUMINA", "HELICOS", "ABI_SOLID", "COMPLETE_GENOMICS", "BGISEQ", "OXFORD_NANOPORE", "PACBIO_SMRT", "ION_TORRENT",
    "VELA_DIAGNOSTICS", "CAPILLARY", "GENAPSYS", "DNBSEQ", "ELEMENT", "GENEMIND", "ULTIMA", "TAPESTRI", "SALUS", "GENEUS_TECH",
    "SINGULAR_GENOMICS", "GENEXUS", "REVOLOCITY",
]

# Instrument models of each platform.
INSTRUMENTS = {
    "LS454": ["454 GS", "454 GS 20", "454 GS FLX", "454 GS FLX+", "454 GS FLX Titanium", "454 GS Junior"],
    "ILLUMINA": [
        "Illumina Genome Analyzer", "Illumina Genome Analyzer II", "Illumina Genome Analyzer IIx", "Illumina HiSeq 2000", "Illumina HiSeq 2500",
        "Illumina HiSeq 3000", "Illumina HiSeq 4000", "Illumina HiSeq X", "Illumina HiSeq X Ten", "Illumina HiSeq X Five", "Illumina MiSeq",
        "Illumina MiniSeq", "Illumina NextSeq 500", "Illumina NextSeq 550", "Illumina NextSeq 1000", "Illumina NextSeq 2000",
        "Illumina NovaSeq 6000", "Illumina NovaSeq X", "Illumina iSeq 100", "HiSeq X Ten", "HiSeq X Five", "NextSeq 500", "NextSeq 550",
        "NextSeq 1000", "NextSeq 2000", "NovaSeq X Plus",
    ],
    "HELICOS": ["Helicos HeliScope"],
    "ABI_SOLID": ["AB SOLiD System", "AB SOLiD System 2.0", "AB SOLiD System 3.0", "AB SOLiD 4 System", "AB SOLiD 4hq System", "AB SOLiD PI System", "AB 5500 Genetic Analyzer", "AB 5500xl Genetic Analyzer"],
    "COMPLETE_GENOMICS": ["Complete Genomics"],
    "BGISEQ": ["BGISEQ-50", "BGISEQ-500", "MGISEQ-200", "MGISEQ-2000", "DNBSEQ-G50", "DNBSEQ-G400", "DNBSEQ-T7"],
    "OXFORD_NANOPORE": ["MinION", "GridION", "GridION X5", "PromethION", "PromethION 24", "PromethION 48", "Flongle", "P2 Solo"],
    "PACBIO_SMRT": ["PacBio RS", "PacBio RS II", "Sequel", "Sequel II", "Sequel IIe", "Onso", "Revio"],
    "ION_TORRENT": ["Ion Torrent PGM", "Ion Torrent Proton", "Ion S5", "Ion S5 XL", "Ion GeneStudio S5", "Ion GeneStudio S5 Plus", "Ion GeneStudio S5 Prime", "Ion Torrent Genexus"],
    "VELA_DIAGNOSTICS": ["Vela Diagnostics Sentosa SQ301"],
    "CAPILLARY": ["AB 3730xL Genetic Analyzer", "AB 3730 Genetic Analyzer", "AB 3500xL Genetic Analyzer", "AB 3500 Genetic Analyzer", "AB 3130xL Genetic Analyzer", "AB 3130 Genetic Analyzer", "AB 310 Genetic Analyzer"],
    "GENAPSYS": ["GENAPSYS Sequencer", "Genapsys Sequencer GS111"],
    "DNBSEQ": ["DNBSEQ-G50", "DNBSEQ-G400", "DNBSEQ-T7", "DNBSEQ-G99", "DNBSEQ-T10x4", "DNBSEQ-T20x2"],
    "ELEMENT": ["Element AVITI"],
    "GENEMIND": ["GeneMind FASTASeq 300", "GeneMind FASTASeq 3000"],
    "ULTIMA": ["UG 100", "Ultima Genomics UG 100"],
    "TAPESTRI": ["Tapestri", "Mission Bio Tapestri"],
    "SALUS": ["Salus Sequencer"],
    "GENEUS_TECH": ["Geneus Tech Sequencer"],
    "SINGULAR_GENOMICS": ["G4", "Singular Genomics G4"],
    "GENEXUS": ["GeneStudio", "Ion Torrent Genexus"],
    "REVOLOCITY": ["Revolocity"],
}

# Library strategies by category.
STRATEGY_CATEGORY = {
    "genomic": ["WGS", "WGA", "WXS", "WCS", "CLONE", "POOLCLONE", "AMPLICON", "CLONEEND", "FINISHING", "RAD-Seq"],
    "transcriptomic": ["RNA-Seq", "ssRNA-seq", "miRNA-Seq", "ncRNA-Seq", "FL-cDNA", "EST"],
    "epigenetic": ["ChIP-Seq", "ATAC-seq", "Bisulfite-Seq", "MeDIP-Seq", "MBD-Seq", "MRE-Seq", "MNase-Seq", "DNase-Hypersensitivity", "FAIRE-seq"],
    "structural": ["Hi-C", "ChIA-PET", "Tethered Chromatin Conformation Capture"],
    "other": ["CTS", "Tn-Seq", "VALIDATION", "SELEX", "RIP-Seq", "Synthetic-Long-Read", "Targeted-Capture", "OTHER"],
}
STRATEGIES = [s for names in STRATEGY_CATEGORY.values() for s in names]

# Library sources and selections.
SOURCES = ["GENOMIC", "GENOMIC SINGLE CELL", "TRANSCRIPTOMIC", "TRANSCRIPTOMIC SINGLE CELL", "METAGENOMIC", "METATRANSCRIPTOMIC", "SYNTHETIC", "VIRAL RNA", "OTHER"]
SELECTIONS = [
    "RANDOM", "PCR", "RANDOM PCR", "RT-PCR", "HMPR", "MF", "CF-S", "CF-M", "CF-H", "CF-T", "MDA", "MSLL", "cDNA", "cDNA_randomPriming",
    "cDNA_oligo_dT", "PolyA", "Oligo-dT", "Inverse rRNA", "Inverse rRNA selection", "ChIP", "ChIP-Seq", "MNase", "DNase", "Hybrid Selection",
    "Reduced Representation", "Restriction Digest", "5-methylcytidine antibody", "MBD2 protein methyl-CpG binding domain", "CAGE", "RACE",
    "size fractionation", "Padlock probes capture method", "other", "unspecified",
]

# Study types, run file types, analysis types.
STUDY_TYPES = [
    "Whole Genome Sequencing", "Metagenomics", "Transcriptome Analysis", "Epigenetics", "Synthetic Genomics", "Forensic or Paleo-genomics",
    "Gene Regulation Study", "Cancer Genomics", "Population Genomics", "RNASeq", "Exome Sequencing", "Pooled Clone Sequencing", "Other",
]
RUN_FILE_TYPES = ["sra", "srf", "sff", "fastq", "fasta", "tab", "bam", "bai", "cram", "crai", "vcf", "bcf"]
ANALYSIS_TYPES = ["DE_NOVO_ASSEMBLY", "REFERENCE_ALIGNMENT", "SEQUENCE_ANNOTATION", "ABUNDANCE_MEASUREMENT"]

# Names of organisms.
ORGANISMS = {
    "homo sapiens": "Homo sapiens",
    "human": "Homo sapiens",
    "mouse": "Mus musculus",
    "mus musculus": "Mus musculus",
    "rat": "Rattus norvegicus",
    "rattus norvegicus": "Rattus norvegicus",
    "e. coli": "Escherichia coli",
    "e.coli": "Escherichia coli",
    "escherichia coli": "Escherichia coli",
    "yeast": "Saccharomyces cerevisiae",
    "saccharomyces cerevisiae": "Saccharomyces cerevisiae",
    "fruit fly": "Drosophila melanogaster",
    "drosophila": "Drosophila melanogaster",
    "drosophila melanogaster": "Drosophila melanogaster",
    "zebrafish": "Danio rerio",
    "danio rerio": "Danio rerio",
    "c. elegans": "Caenorhabditis elegans",
    "c.elegans": "Caenorhabditis elegans",
    "caenorhabditis elegans": "Caenorhabditis elegans",
}

# Spellings of library strategies.
STRATEGY_SPELLINGS = {
    "rnaseq": "RNA-Seq",
    "rna seq": "RNA-Seq",
    "wgs": "WGS",
    "wes": "WES",
    "wxs": "WXS",
    "chipseq": "ChIP-Seq",
    "chip seq": "ChIP-Seq",
    "atacseq": "ATAC-Seq",
    "atac seq": "ATAC-Seq",
    "amplicon": "AMPLICON",
    "targeted": "Targeted-Capture",
    "bisulfite": "Bisulfite-Seq",
    "hic": "Hi-C",
    "hi c": "Hi-C",
    "mirnaseq": "miRNA-Seq",
    "mirna seq": "miRNA-Seq",
}

# Prefixes of accessions and the words that show what a query is about.
RECORD_TYPES = {"study": ["SRP", "ERP", "DRP"], "experiment": ["SRX", "ERX", "DRX"], "sample": ["SRS", "ERS", "DRS"], "run": ["SRR", "ERR", "DRR"]}
ID_SYSTEMS = ["SRP", "SRX", "SRS", "SRR", "DRP", "DRX", "DRS", "DRR", "ERP", "ERX", "ERS", "ERR", "GSE", "GSM", "PRJNA", "PRJEB", "PRJDB", "SAMN", "SAME", "SAMD"]
TECHNICAL_TERMS = ["ILLUMINA", "PACBIO", "RNA-SEQ", "WGS", "CHIP-SEQ", "ATAC-SEQ", "SINGLE", "PAIRED", "TRANSCRIPTOME", "GENOME"]
STUDY_TERMS = ["CANCER", "DISEASE", "PATIENT", "TREATMENT", "STUDY", "CLINICAL", "COHORT", "HUMAN", "MOUSE", "CELL"]
