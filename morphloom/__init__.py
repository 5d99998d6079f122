"""morphloom: corpus-linguistics analytics as Spark plans.

Every public operator takes DataFrames and returns a DataFrame; nothing is
computed before the caller's action unless the docstring says so.
"""

__version__ = "0.1.0"
