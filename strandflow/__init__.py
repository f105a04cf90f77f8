"""Statistical genetics and expression-network analytics on Spark DataFrames.

Tables (see ``strandflow.schema``): genotypes(sample_id, vid, dosage), samples(sample_id, ...), variants(vid, ...),
numerics(sample_id, attr_id, value).  An analysis is a function from DataFrames to a DataFrame.
"""
