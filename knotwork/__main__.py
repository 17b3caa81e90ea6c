from knotwork.plans.experiments import main

main()
