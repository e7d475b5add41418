"""No streaming operators: the analysis reads finished graphs.  The lattice aggregate works on streams as it is."""
