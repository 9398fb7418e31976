"""DataFrame operators: media rows, similarity, clusters, groups, selections, image kernels and file actions."""
