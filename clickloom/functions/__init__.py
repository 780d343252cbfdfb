"""Column -> Column functions; everything here stays inside the JVM."""

from pyspark import cloudpickle

from clickloom.functions import arrays

# Tasks get the array functions with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(arrays)
