"""Plans: findings become ordered actions, actions change the model, before and after are compared."""
