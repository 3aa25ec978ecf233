"""seqlab: labelled-sequence analytics and training-data preparation as Spark jobs."""
