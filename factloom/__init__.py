"""factloom: evidence-checked fact extraction and reconciliation on PySpark."""
