"""credora: column-parametric Spark DataFrame operators for labelled tabular data.

Exploration, feature preparation, sampling, modelling and evaluation of a
binary label, each expressed as DataFrame -> DataFrame (or fit -> model ->
DataFrame) so Catalyst plans the work and executors carry every row-sized step.
"""

__version__ = "0.1.0"
