"""Document risk analytics on Spark: rules, findings, reports, corpora and evaluation as DataFrame plans."""
