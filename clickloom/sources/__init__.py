"""Readers: click logs, documents, word vectors, records, generated data."""

from pyspark import cloudpickle

from clickloom.sources import files, records, text, tfrecord

# Tasks get the data sources with the job, so executors need no installation.
for _module in (files, records, text, tfrecord):
    cloudpickle.register_pickle_by_value(_module)
