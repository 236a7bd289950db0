"""Play-by-play and player analytics on Spark DataFrames."""

from downfield.plans.playbook import Playbook
from downfield.sources.warehouse import Warehouse

# Session settings the operators are written for.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    # The JVM interprets methods beyond 8,000 bytes of bytecode; smaller generated pieces get compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Seasons are pruned by filters that reach the scans; a second pruning at run time costs a scan where two
    # joins could share one.
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false",
}

__all__ = ["SETTINGS", "Playbook", "Warehouse"]
