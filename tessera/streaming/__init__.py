"""Stream monitors: each as a batch query over a log, the stateful ones also over a stream by the same step function."""
