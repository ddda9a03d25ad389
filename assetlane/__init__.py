"""Image and PDF compression analytics over Spark DataFrames.

Sub-packages
------------
functions   column expressions: file typing, paths, savings, settings JSON, text
operators   DataFrame -> DataFrame operators: intake, pixels, sweeps, PDF, batch
plans       skew-safe building blocks shared by the operators
sources     reading asset folders and preset files, writing results
streaming   Structured Streaming operators and their batch twins
suite       fixture views and the registry behind ``__spark_entry__.py``
"""

from assetlane.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
