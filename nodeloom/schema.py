"""Column contracts of the tables that operators exchange (keys are always explicit).

graphs       graph_id, n_nodes, n_markers [, meta map<string,double>, organoid_id]
nodes        graph_id, node_id, x (one number per marker), y [, y_orig, y_base]
edges        graph_id, src, dst     symmetric, without loops and repeats
markers      marker_id (position in x), name
predictions  nodes plus yhat

Statistics of groups without rows are NULL, never NaN.
"""

from __future__ import annotations

GRAPHS = "graph_id string, n_nodes bigint, n_markers int, meta map<string,double>, organoid_id string"
NODES = "graph_id string, node_id bigint, x array<float>, y double"
EDGES = "graph_id string, src bigint, dst bigint"
MARKERS = "marker_id int, name string"
HISTORY = "epoch int, train_loss double, train_mae double, val_loss double, val_mae double"
BINNED = "bin int, edge_lo double, edge_hi double, count bigint, y_true_mean double, y_true_std double, y_pred_mean double, MAE double, RMSE double, bias double"
