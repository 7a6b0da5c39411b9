"""latticework: voxel, region-graph and landmark analytics on PySpark DataFrames."""
