"""The library's functions for SQL, under names that start with dna_."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandlake.functions import melting, structures, tables


def register(spark: SparkSession) -> list[str]:
    """Arrow functions for the dynamic programs, table functions for contigs that come in parts, and SQL functions
    (expressions, no Python) for the rest; the names."""
    spark.udf.register("dna_dimer", structures.dimer_udf(False))
    spark.udf.register("dna_dimer_3p", structures.dimer_udf(True))
    spark.udf.register("dna_hairpin", structures.hairpin_udf())
    spark.udf.register("dna_fold", structures.fold_udf())
    spark.udf.register("dna_unpaired", structures.unpaired_udf())
    spark.udf.register("dna_melt_curve", melting.theta_udf())
    expressions = {
        "dna_reverse_complement(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
        "dna_gc_fraction(s STRING) RETURNS DOUBLE": "(length(s) - length(translate(s, 'GC', ''))) / length(s)",
        "dna_gc_clamp(s STRING) RETURNS INT": "length(right(s, 5)) - length(translate(right(s, 5), 'GC', ''))",
        "dna_longest_run(s STRING) RETURNS INT": "coalesce(array_max(transform(regexp_extract_all(s, '(A+|C+|G+|T+)', 1), x -> length(x))), 0)",
        "dna_cpg(s STRING) RETURNS INT": "regexp_count(s, 'CG')",
        "dna_bisulfite(s STRING) RETURNS STRING": "translate(s, 'Cc', 'Tt')",
        "dna_hamming(a STRING, b STRING) RETURNS INT": "aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x = y, 0, 1)), 0, (n, x) -> n + x)",
    }
    for head, body in expressions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return sorted([h.split("(")[0] for h in expressions] + tables.register(spark) + ["dna_dimer", "dna_dimer_3p", "dna_hairpin", "dna_fold", "dna_unpaired", "dna_melt_curve"])
