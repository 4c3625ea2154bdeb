"""voxelflow: scene labelling and point analytics as PySpark DataFrame transforms."""
