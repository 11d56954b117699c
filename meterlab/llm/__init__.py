"""Operators for large text corpora and the queries that apply them.

``stages``     tables written to the shared folder and dropped again
``ordering``   global row numbers and running sums without a one-task sort
``bytes``      words, lines and hashes of whole Arrow batches as numpy arrays
``tokens``     token ids of whole batches, looked up piece by piece
``tallies``    exact counts of strings, packed by bucket
``packing sharding linefreq substrings langid pulearn mixing huffman ctph jaccard divergence pieces collocations``
               the thirteen operators
``queries``    their registered queries, SQL twins in ``twins``
"""
