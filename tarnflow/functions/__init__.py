"""Column functions: geometry of rasters and poses, and the physics of fills, throats and films."""
